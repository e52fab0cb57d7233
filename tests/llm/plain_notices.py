"""A plain version of the notice comparison, text by text."""

import math
import re
from collections import Counter

HEADER = re.compile(r"licen[sc]e|copyright|spdx|public domain")
SPDX = re.compile(r"spdx-license-identifier:[\s(]*([a-z0-9.+-]+)")
COMMENT = re.compile(r"^\s*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|<!--|\"\"\"|''')\s?")
HELD_LINE = re.compile(r"^\W*(?:copyright\b|\(c\)|all rights reserved|portions copyright)")


def nearest(known, text: str) -> tuple[float, str]:
    """Score (nine decimals) and licence; equal scores go to the smaller name."""
    v = known._weigh(Counter(re.findall("[a-z0-9]+", text)))
    norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
    best = (0.0, "")
    for name, t in known.vectors:
        small, large = (v, t) if len(v) < len(t) else (t, v)
        score = round(sum(w * large[k] for k, w in small.items() if k in large) / norm, 9)
        if score > best[0] or score == best[0] > 0 and name < best[1]:
            best = (score, name)
    return best


def find(known, text: str, whole: bool, least: float) -> tuple[str, float] | None:
    """``whole``: compare the text as one bag too (a licence file)."""
    text = text.lower()
    for found in SPDX.finditer(text):
        name = re.sub(r"(?:-only|-or-later|\+)$", "", found[1])
        if name in known.names:
            return known.names[name], 1.0
    best = (0.0, "")
    for part in pieces(text) | ({text} if whole else set()):
        score, name = nearest(known, part)
        if score > best[0] or score == best[0] > 0 and name < best[1]:
            best = (score, name)
    return (best[1], best[0]) if best[0] >= least else None


def pieces(text: str) -> set[str]:
    """Runs of comment or plain lines with a header word, their paragraphs, sentences and lines.

    Lines that only name the holders are left out: they are no part of any licence.
    """
    runs: list[list[str]] = []
    before = None
    for line in text.split("\n"):
        mark = COMMENT.match(line)
        kind = "comment" if mark else "plain" if line.strip() else None
        if kind is None or kind != before:
            runs.append([])
        before = kind
        if kind:
            runs[-1].append(line[mark.end() :] if mark else line)
    out = set()
    for run in runs:
        if not any(HEADER.search(line) for line in run):
            continue
        paragraphs: list[list[str]] = [[]]
        for line in run:
            if not line.strip():
                paragraphs.append([])
            elif not HELD_LINE.match(line):
                paragraphs[-1].append(line)
        joined = [" ".join(p) for p in paragraphs if p]
        out.add(" ".join(joined))
        out.update(line for p in paragraphs for line in p if HEADER.search(line))
        for p in joined:
            if HEADER.search(p):
                out.add(p)
                out.update(s for s in re.split(r"(?<=[.!?:;])\s+", p) if HEADER.search(s))
    return out
