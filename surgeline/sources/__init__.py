"""Reading usage and snapshots, and the versioned tables behind a running watch."""
