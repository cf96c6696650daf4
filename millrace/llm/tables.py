"""Written tables, as the library has them."""

from millrace.plans.tables import discard, settings, shared_folder, written

__all__ = ["discard", "settings", "shared_folder", "written"]
