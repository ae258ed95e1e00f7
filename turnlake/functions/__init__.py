"""turnlake subpackage."""
