"""Statistics of a whole text as a fixed row of numbers, for the tree classifiers."""

from __future__ import annotations

import numpy as np

_CODES = np.arange(256)
#: Byte classes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 symbol, 8 start of a longer character, 9 its rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[(_CODES >= 97) & (_CODES <= 122)] = 1
_CLASS[(_CODES >= 65) & (_CODES <= 90)] = 2
_CLASS[(_CODES >= 48) & (_CODES <= 57)] = 3
_CLASS[np.isin(_CODES, [9, 10, 11, 12, 13, 32])] = 4
_CLASS[np.isin(_CODES, list(b".!?"))] = 5
_CLASS[np.isin(_CODES, list(b",;:'\"-()"))] = 6
_CLASS[np.isin(_CODES, list(b"#*$%&|<>@^~_+=/\\[]{}`"))] = 7
_CLASS[_CODES >= 0xC0] = 8
_CLASS[(_CODES >= 0x80) & (_CODES < 0xC0)] = 9

NAMES = (
    "log_words", "log_chars", "mean_word", "distinct_words", "lower", "upper", "digits", "space", "sentence_marks", "other_marks", "symbols", "beyond_ascii",
    "exclaims", "pipes", "log_lines", "words_per_line", "duplicate_lines", "short_lines", "marked_lines", "upper_words", "symbol_words", "longest_word", "top_word", "duplicate_parts", "mixed_words",
)


def byte_classes(data: bytes) -> np.ndarray:
    return _CLASS[np.frombuffer(data, np.uint8)]


def text_stats(data: bytes, classes: np.ndarray | None = None) -> list[float]:
    """The numbers named in NAMES; all zero for an empty text. Shares are of characters, words or lines."""
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    classes = byte_classes(data) if classes is None else classes
    per = np.bincount(classes, minlength=10).tolist()
    chars = len(data) - per[9]
    n = len(words)
    lowered = data.lower().split()
    times: dict[bytes, int] = {}
    for w in lowered:
        times[w] = times.get(w, 0) + 1
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    parts = [p for p in data.replace(b"\n", b".").split(b".") if len(p) > 8]
    letters = classes == 1
    inside = int((letters[:-2] & np.isin(classes[1:-1], (3, 7)) & letters[2:]).sum()) if len(classes) > 2 else 0
    return [
        float(np.log1p(n)), float(np.log1p(chars)), (chars - per[4]) / n, len(times) / n, per[1] / chars, per[2] / chars, per[3] / chars, per[4] / chars, per[5] / n, per[6] / n, per[7] / n, per[8] / chars,
        data.count(b"!") / n, data.count(b"|") / n, float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), sum(map(bytes.isupper, words)) / n, per[7] / max(1, per[1] + per[2]), float(max(map(len, words))), max(times.values()) / n,
        1 - len(set(parts)) / max(1, len(parts)) if parts else 0.0, inside / n,
    ]
