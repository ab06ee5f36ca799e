"""Writers and report contracts."""
