"""Structure statistics of texts, shared by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

from ._text import SPACE, windows, words_of

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_exclaim", "n_distinct", "n_short",
)

# The symbols that the base rule counts.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = b" \t\n\x0b\x0c\r"


def repeated(h: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text has twice or more, the first one included."""
    w = windows(h, 3)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    covered[: len(w)] |= hit
    covered[1 : len(w) + 1] |= hit
    covered[2 : len(w) + 2] |= hit
    return int(covered.sum())


def text_stats(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(len(texts) x FIELDS counts, folded word hashes, bounds of each text's words)."""
    plain, bounds, start, end, data = words_of(texts, fold=False)
    folded = words_of(texts, fold=True)[0]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    at[-1] -= 1

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    out = np.zeros((len(texts), len(FIELDS)), np.int64)
    out[:, 0] = np.diff(bounds)
    out[:, 1] = per_text(~SPACE[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = per_text(_SYMBOL[data])
    out[:, 6] = per_text(_UPPER[data])
    out[:, 7] = per_text(data == 33)
    short = np.concatenate([[0], np.cumsum((end - start) <= 3)])
    out[:, 9] = short[bounds[1:]] - short[bounds[:-1]]
    for i, t in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            lines = [x for x in (t or b"").split(b"\n") if x.strip(_BLANK)]
            out[i, 3] = len(lines) - len(set(lines))
            out[i, 5] = len(lines)
            out[i, 4] = repeated(plain[a:b])
            x = np.sort(folded[a:b])
            out[i, 8] = 1 + int((x[1:] != x[:-1]).sum())
    return out, folded, bounds


def ratios(c: np.ndarray) -> np.ndarray:
    """Size-free statistics (one row per text): symbols, repeats, copied lines, capitals, exclamations,
    characters per word, distinct words against what a text of that length has, short words."""
    f = c.astype(np.float64)
    words, chars, lines = np.maximum(f[:, 0], 1), np.maximum(f[:, 1], 1), np.maximum(f[:, 5], 1)
    return np.stack(
        [
            f[:, 2] / words, f[:, 4] / words, f[:, 3] / lines, f[:, 6] / chars,
            f[:, 7] / words, chars / words, f[:, 8] / words ** 0.85, f[:, 9] / words,
        ],
        axis=1,
    )
