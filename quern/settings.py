"""A run's settings and their checks; a bad value is a ValueError with a sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from quern.schemas import RIGHTS_FIELDS, TARGETS

MODES = ("same", "webp", "avif", "suite")
_URL_FIELDS = ("webStatement", "licensorUrl", "digitalSourceType")


def is_web_url(value: str) -> bool:
    """An absolute http or https address with a host."""
    try:
        parts = urlsplit(value.strip())
        return parts.scheme.lower() in ("http", "https") and bool(parts.netloc)
    except ValueError:
        return False


def rights_error(name: str, value: str) -> str | None:
    """What is wrong with a rights option, or None."""
    if not value.strip():
        return f"{name} is empty"
    if name in _URL_FIELDS and not is_web_url(value):
        return f"{name} is not an http or https address"
    return None


def parse_target(text: str) -> float:
    """A preset's name, or a number from 0 to 100."""
    if text in TARGETS:
        return float(TARGETS[text])
    if not re.fullmatch(r"\d+(\.\d+)?", text) or float(text) > 100:
        raise ValueError(f"{text!r} is neither a preset ({', '.join(TARGETS)}) nor a number from 0 to 100")
    return float(text)


def parse_count(text: str) -> int:
    """A whole number from 1."""
    if not re.fullmatch(r"\d+", text) or int(text) < 1:
        raise ValueError(f"{text!r} is not a whole number from 1")
    return int(text)


def parse_text(text: str) -> str:
    if not text.strip():
        raise ValueError("the value is empty")
    return text.strip()


def parse_url(text: str) -> str:
    if not is_web_url(text):
        raise ValueError(f"{text!r} is not an http or https address")
    return text.strip()


def parse_diff_path(text: str) -> str:
    if not text.lower().endswith(".png"):
        raise ValueError(f"{text!r} does not end in .png")
    return text


@dataclass(frozen=True)
class Settings:
    """Checked settings; rights hold trimmed, non-empty values."""

    mode: str = "same"
    target: float = float(TARGETS["web"])
    strip_all: bool = False
    in_place: bool = False
    overwrite: bool = False
    max_width: int | None = None
    out_dir: str | None = None
    rights: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is not one of {', '.join(MODES)}")
        if not 0 <= self.target <= 100:
            raise ValueError("target is not from 0 to 100")
        if self.max_width is not None and (not isinstance(self.max_width, int) or self.max_width < 1):
            raise ValueError("max_width is not a whole number from 1")
        if self.strip_all and self.rights:
            raise ValueError("rights cannot be added when all metadata is stripped")
        for name, value in self.rights.items():
            if name not in RIGHTS_FIELDS:
                raise ValueError(f"{name} is no rights field")
            if error := rights_error(name, value):
                raise ValueError(error)
        object.__setattr__(self, "rights", {k: v.strip() for k, v in self.rights.items()})
