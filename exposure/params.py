"""Job parameters: plain values a caller may override, with the defaults of the checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Directory names that hold no secrets worth tracking.
SKIP_DIRS = (
    "node_modules", ".git", "vendor", "dist", "build", ".next",
    "target", "out", ".cache", "coverage", ".venv", "__pycache__",
)
# Directories also skipped when looking for residue.
RESIDUE_SKIP_DIRS = ("node_modules", ".git", "Library", "Applications")
# Files holding ignore rules, read from the root of a surface.
IGNORE_FILES = (".gitignore", ".exposureignore")
# Environment keys whose values are not secrets.
KEY_IGNORE_PATTERNS = (
    "PATH", "HOME", "PWD", "USER", "SHELL", "TERM",
    "LANG", "LC_*", "EDITOR", "VISUAL", "PAGER",
    "COLORTERM", "DISPLAY", "XDG_*",
    "DBUS_*", "DESKTOP_SESSION", "GNOME_*", "KDE_*",
    "SSH_*", "GPG_*", "LESS*", "MORE",
    "PS1", "PS2", "PROMPT*", "HIST*", "HISTSIZE",
    "LOG_*", "*_NONSECRET", "BUILD_*", "CI_*",
    "NODE_ENV", "DEBUG", "TEST_*",
)
# Files that are allowed to hold secrets.
ENV_FILE_PATTERNS = (".env*",)
# Directories below the home directory searched for residue by default.
DEFAULT_SURFACE_DIRS = ("Downloads", "Documents", "Desktop")

PLACEHOLDER = "[REDACTED]"
GENERIC_MIN_HITS = 3
RECEIPT_TAG = "exposure-scrub-receipt"
SCRUB_MARKER = "scrub-history"


@dataclass(frozen=True)
class Gate:
    """What makes a string plausible as a secret: byte length and Shannon entropy."""

    min_len: int = 8
    min_entropy: float = 4.0

    @property
    def min_distinct(self) -> int:
        """Distinct characters needed to reach ``min_entropy``.

        d distinct characters give at most log2(d) bits. Frequencies are divided by the byte
        length, which only lowers the value once d >= 3, so the bound is exact from there on.
        """
        d = math.ceil(2.0**self.min_entropy - 1e-6)
        return d if d >= 3 else 1

    @property
    def min_chars(self) -> int:
        """Characters (not bytes) a string needs before it can pass; used inside patterns.

        k characters in n bytes give at most k * log2(n) / n bits, which falls as n grows from
        3 on, so k >= min_entropy * min_len / log2(min_len).
        """
        n = self.min_len
        by_ratio = math.ceil(self.min_entropy * n / math.log2(n) - 1e-6) if n >= 3 else 1
        return max(self.min_distinct, math.ceil(n / 4), by_ratio)


@dataclass(frozen=True)
class Surface:
    """A directory searched for residue and the file patterns that apply to it."""

    path: str
    files: tuple[str, ...] = ()


def merge_surfaces(surfaces) -> list[Surface]:
    """One surface per directory in first-seen order, its patterns united and sorted."""
    merged: dict[str, set[str]] = {}
    for s in surfaces:
        if s.path:
            merged.setdefault(s.path.rstrip("/") or "/", set()).update(s.files)
    return [Surface(path, tuple(sorted(files))) for path, files in merged.items()]


def default_surfaces(home: str) -> list[Surface]:
    return [Surface(f"{home.rstrip('/')}/{d}", ("**/*",)) for d in DEFAULT_SURFACE_DIRS]


def effective_mode(mode: str | None) -> str:
    """``delete`` unless ``redact`` was asked for."""
    return "redact" if mode == "redact" else "delete"


def effective_placeholder(monitor: str = "", history: str = "", fallback: str = "") -> str:
    """The monitor's own placeholder wins over the history one, then the fallback."""
    return monitor or history or fallback or PLACEHOLDER


@dataclass(frozen=True)
class PathPolicy:
    """Where secrets belong (roots) and where they are looked for (surfaces)."""

    roots: tuple[str, ...] = ()
    root_patterns: tuple[str, ...] = ENV_FILE_PATTERNS
    roots_enabled: bool = True
    surfaces: tuple[Surface, ...] = ()
    skip_dirs: tuple[str, ...] = tuple(dict.fromkeys(SKIP_DIRS + RESIDUE_SKIP_DIRS))


@dataclass(frozen=True)
class MonitorPolicy:
    """Timeouts of the snapshot monitor; zero or less switches an action off."""

    redact_after_s: int = 30
    clear_after_s: int = 60
    alerts: bool = True
    clear_after_redact: bool = False
    placeholder: str = field(default=PLACEHOLDER)
