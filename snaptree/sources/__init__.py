"""Where snapshots come from and go to."""
