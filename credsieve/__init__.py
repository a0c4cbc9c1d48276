"""Find leaked credentials in text tables, file trees and diffs, on Spark."""

from credsieve.config import (
    Allowlist,
    EntropySettings,
    RegexRule,
    ScanSettings,
    SettingsError,
    default_settings,
    merge_settings,
    user_settings,
)
from credsieve.plans.scan import Scan, scan

__version__ = "0.1.0"

__all__ = [
    "Allowlist",
    "EntropySettings",
    "RegexRule",
    "Scan",
    "ScanSettings",
    "SettingsError",
    "default_settings",
    "merge_settings",
    "scan",
    "user_settings",
]
