"""Readers and writers."""
from gridloom.sources.buckets import write_bucketed  # noqa: F401
from gridloom.sources.files import file_prefixes, write_files  # noqa: F401
from gridloom.sources.grids import grid_from_events, plane_from_arrays, rgb_from_arrays  # noqa: F401
from gridloom.sources.images import list_images, read_images, scan_codec_files  # noqa: F401
from gridloom.sources.sinks import read_window, write_planes, write_report, write_zordered  # noqa: F401
