"""Readers of the surveillance views, dated snapshots and report sinks."""
