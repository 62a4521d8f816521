"""Chapter rules: defaults, normalization and files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

#: What may stand between a chapter prefix and its keyword.
NUMBERS = "0-9一二三四五六七八九十百千万零两〇壹贰叁肆伍陆柒捌玖拾佰仟廿卅"


@dataclass(frozen=True)
class Rules:
    """How headings look; the defaults are fixed values."""

    chapterPrefix: str = "第"
    chapterSuffixes: tuple[str, ...] = ("章", "回", "节")
    chapterKeywords: tuple[str, ...] = ("章", "回", "节")
    titleStarts: tuple[str, ...] = ("序章", "楔子", "后记", "番外")
    titleContains: tuple[str, ...] = ("创作手记", "后记", "楔子")
    minTitleLength: int = 2
    maxTitleLength: int = 20
    ignorePatterns: tuple[str, ...] = ("^\\s*$",)
    strictNumberMode: bool = True
    useEmptyLineAsTitle: bool = False

    def marker(self, words: tuple[str, ...]) -> str | None:
        """Regex of prefix, number and one of the words, unanchored; None without a prefix or words."""
        found = [re.escape(w) for w in words if w]
        return f"{re.escape(self.chapterPrefix)}[{NUMBERS}]+(?:{'|'.join(found)})" if self.chapterPrefix and found else None


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def _word_list(value: Any, default: tuple[str, ...]) -> tuple[str, ...]:
    if isinstance(value, str):
        value = re.split("[,，\n]", value) if value.strip() else None
    if not isinstance(value, (list, tuple)):
        return default
    return tuple(w for w in (str(x).strip() for x in value) if w) or default


def _positive(value: Any, default: int) -> int:
    m = re.match(r"\s*([+-]?\d+)", str(value))
    return int(m[1]) if m and int(m[1]) > 0 else default


def normalize(source: Any) -> Rules:
    """Rules of any mapping: what is missing or makes no sense takes its default."""
    s, d = (source if isinstance(source, dict) else {}), Rules()
    prefix = s.get("chapterPrefix")
    patterns = s.get("ignorePatterns")
    patterns = [str(p).strip() for p in patterns] if isinstance(patterns, (list, tuple)) else list(d.ignorePatterns)
    low, high = _positive(s.get("minTitleLength"), d.minTitleLength), _positive(s.get("maxTitleLength"), d.maxTitleLength)
    return Rules(
        prefix.strip() if isinstance(prefix, str) and prefix.strip() else d.chapterPrefix,
        *(_word_list(s.get(k), getattr(d, k)) for k in ("chapterSuffixes", "chapterKeywords", "titleStarts", "titleContains")),
        *((low, high) if low < high else (d.minTitleLength, d.maxTitleLength)),
        tuple(p for p in patterns if p and _valid(p)),
        d.strictNumberMode if s.get("strictNumberMode") is None else bool(s["strictNumberMode"]),
        bool(s.get("useEmptyLineAsTitle")),
    )


def load_rules(path: str) -> Rules:
    """Rules of a JSON file; if it can't be read, the defaults, which are then written there."""
    try:
        return normalize(asdict(Rules()) | json.loads(Path(path).read_text("utf-8")))
    except (OSError, ValueError, TypeError):
        return save_rules(path, {})


def save_rules(path: str, rules: Any) -> Rules:
    out = normalize(rules)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(out), ensure_ascii=False, indent=2), "utf-8")
    return out
