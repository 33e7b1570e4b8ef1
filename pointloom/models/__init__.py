"""Voxel scorer: training on the driver from voxel-level rows, inference as an Arrow function."""
