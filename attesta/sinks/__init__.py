"""Writers. All write in parallel, one file per task."""
