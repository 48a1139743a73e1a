"""Where traces come from and go to."""
