"""Keyed folds over ordered events: the same state machines run over a table and over a stream."""
