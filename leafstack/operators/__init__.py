"""DataFrame-to-DataFrame operators of the layout pipeline."""
