"""Intermediate tables and sized joins, as the rest of the engine has them."""

from ..sources.scratch import BROADCAST_ROWS, exists, input_bytes, new_path, numbered, release, remove, shared_dir, sized, written

__all__ = ["BROADCAST_ROWS", "exists", "input_bytes", "new_path", "numbered", "release", "remove", "shared_dir", "sized", "written"]
