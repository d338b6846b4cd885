"""Tables from a library tree, sidecars and snapshots."""
