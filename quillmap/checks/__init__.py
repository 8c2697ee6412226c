"""Checked queries over the driver tables."""

from quillmap.checks import bundle_checks, extract_checks, file_checks, project_checks  # noqa: F401
from quillmap.checks.catalog import ORACLES, QUERIES  # noqa: F401
