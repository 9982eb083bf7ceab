"""Readers and writers: map responses, raw tracks, the journal, polylines, GeoJSON, cached requests."""
