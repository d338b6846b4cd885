"""Set-wise operators over library tables."""
