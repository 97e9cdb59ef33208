"""Extraction jobs; importing the package fills the registry."""

from fleetlens.extract import commands, configuration, logins, services, snapshots, status, syslog  # noqa: F401
from fleetlens.extract.base import REGISTRY, Extractor, complete, extract_all, extractor  # noqa: F401
