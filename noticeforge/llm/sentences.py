"""Sentence boundaries by a hidden-event n-gram model: boundary events between words, decided by forward-backward posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.plans.joins import fan_out
from noticeforge.sources.tables import materialized

#: Counters of n-grams in each of two tables, by two hashes: 32 MB whatever the input. n-grams that meet in a counter share it; of
#: an n-gram's two counters the smaller one holds, so that one of a few counts does not speak for a frequent one or the other way
#: round. None is left out for being rare, but what was seen less often than MIN_COUNT says nothing.
SLOTS, MIN_COUNT = 1 << 21, 2
ROUNDS = 4
#: Share of undecided places that are taken for boundaries before anything is known about the words around, by kind:
#: a mark with and without a blank after it, a blank in Thai, a line break without and with a mark.
SEED_PRIOR = {"P": 0.7, "p": 0.6, "T": 0.3, "B": 0.1, "W": 0.05, "b": 0.7}
#: Longest line, in characters, of a text whose lines may be broken within sentences.
WRAP_WIDTH = 100
#: Part of a block's width up to which a line of a broken text is filled.
SLACK = 0.85

_TOKEN = regex.compile(
    r"(?P<nl>[^\S\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])[\s﻿]*)"
    r"|(?P<sp>[\s﻿​]+)"
    r"|(?P<end>[.!?…。．！？｡।॥؟۔‥⁇⁈⁉။។៕]+)"
    r"|(?P<open>[“‘「『（(\[【《<«„‚〈])"
    r"|(?P<close>[”’」』）)\]】》>»〉\"'＂])"
    r"|(?P<thai>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)"
    r"|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}ー]+)"
    r"|(?P<num>\d+(?:[,:/\-]\d+)*)"
    r"|(?P<word>[\p{L}\p{M}][\p{L}\p{M}‌‍'’]*)"
    r"|(?P<mark>.)",
    regex.S,
)
#: What a list item or an answer on a line of its own begins with.
_LEAD = regex.compile(
    r"[-–—*•·○●■□▶▷►※◆◇☞☆★▪◦‣✓✔✽ㅇㆍ〇]|[①-⑳㉠-㉻㈀-㈎Ⅰ-ⅻ⑴-⒇ⓐ-ⓩ]|\(?(?:\d{1,3}|[a-zA-Z]|[가-하]|[ivxIVX]{1,4}|[一二三四五六七八九十]{1,3}|[ก-ฮ])[.)](?=\s|[^\d\s])(?!\d)|(?:Q|A|문|답|질문|답변|Question|Answer|F|問|答|问|س|ج)\s?\d*\s?[.:：)\]]|\[[^\]\n]{1,12}\]|\p{L}[\p{L} ]{0,15}\s?[:：]\s|제\s?\d+\s?[조항장](?!에)|第\s?[\d一二三四五六七八九十百]+\s?[条條章]"
)
_LABEL = regex.compile(r"^[\s﻿]*(?:\(?(?:\d{1,3}|\p{L}{1,2}|[ivxIVX]{1,4})[.)]|(?:Q|A)\s?\d*[.:])$")
#: What follows a date that goes on: its weekday or another remark in brackets, or the end of a period.
_GOES_ON = regex.compile(r"\s*(?:[(（](?!\s*※)|[~～])")
_EOL = regex.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0             　﻿"


class Candidate(NamedTuple):
    """A place where a sentence may end: end of the left part, start of the right one, kind, known event (or None), n-gram context."""

    end: int
    start: int
    kind: str
    known: int | None
    l2: str
    l1: str
    r1: str
    r2: str
    near: bool


def _left(kind: str, s: str) -> str:
    if kind == "num":
        return "0"
    if kind == "thai":
        return s[-8:]
    if kind == "cjk":
        return s[-2:]
    return s.lower()[-4:] if kind == "word" and "가" <= s[-1] <= "힣" else s.lower()[:16]


def _right(kind: str, s: str) -> str:
    if kind == "num":
        return "0"
    if kind == "thai":
        return s[:6]
    if kind == "cjk":
        return s[:2]
    # Capital letters tell a beginning; of a Korean word the ending tells its part in the sentence.
    if kind == "word":
        return s[:2] + "~" + s[-1] if "가" <= s[0] <= "힣" and len(s) > 2 else s[:16]
    return s[:4]


#: Pairs of brackets and quotes.
_PAIRS = dict(zip("“‘「『（([【《<«„‚〈", "”’」』）)]】》>»“‘〉", strict=True))


def _enclosed(text: str, tokens: list[tuple[str, int, int]]) -> list[bool] | None:
    """Of each token whether a pair of brackets or quotes that closes on its line is still open after it; null if there is none."""
    steps: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    for i, t in enumerate(tokens):
        kind = t[0]
        if kind == "nl":
            opened = []
        elif kind == "open":
            opened.append((_PAIRS[text[t[1]]], i))
        elif kind == "close":
            c = text[t[1]]
            match = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == c), None)
            if match is not None:
                at = opened[match][1]
                steps[at] = steps.get(at, 0) + 1
                steps[i] = steps.get(i, 0) - 1
                del opened[match:]
            elif c == '"':
                opened.append((c, i))
    if not steps:
        return None
    out, depth, last = [False] * len(tokens), 0, 0
    for i in sorted(steps):
        if depth > 0:
            out[last:i] = [True] * (i - last)
        depth, last = depth + steps[i], i
    return out


#: Tokens that are no words.
_NO_WORD = frozenset(("sp", "open", "close", "end", "nl"))


def candidates(text: str) -> list[Candidate]:
    """All places of a text where the model has to decide, in order."""
    tokens = [(m.lastgroup, *m.span()) for m in _TOKEN.finditer(text)]
    n = len(tokens)
    # Lines, and the width to which the lines of their block (up to a blank line) may be broken.
    breaks = [i for i, t in enumerate(tokens) if t[0] == "nl"]
    edges = [0, *[tokens[i][2] for i in breaks]]
    ends = [*[tokens[i][1] for i in breaks], len(text)]
    blank = [len(_EOL.findall(text, tokens[i][1], tokens[i][2])) > 1 for i in breaks]
    leads = [bool(_LEAD.match(text, e)) for e in edges]
    width = [0] * len(edges)
    first = 0
    for k in range(len(edges)):
        if k == len(breaks) or blank[k]:
            width[first : k + 1] = [max((ends[j] - edges[j] for j in range(first, k + 1) if not leads[j]), default=0)] * (k + 1 - first)
            first = k + 1

    def fits(k: int, slack: float = 1.0) -> bool:
        """Whether the first word of the next line had room at the end of line k; with slack, in a somewhat narrower block."""
        rest = text[edges[k + 1] : ends[k + 1]].split(None, 1)
        need = 0 if not rest else 1 if _WIDE.match(rest[0]) else len(rest[0])
        return ends[k] - edges[k] + 1 + need <= width[k] * slack

    inner = [k for k in range(len(breaks)) if not blank[k] and not leads[k + 1]]
    tight = {k for k in inner if 12 <= width[k] <= WRAP_WIDTH and not fits(k)}
    running = sum(not regex.search(r"[.!?…。．！？｡।॥؟:：)\]」』”’\"]\s*$", text[edges[k] : ends[k]]) for k in tight)
    wrapped = running >= 2 and len(tight) >= 0.5 * len(inner)
    # In a broken text a line may be a little short, as where wide letters were counted twice.
    forced = [k not in tight and (not wrapped or fits(k, SLACK)) for k in range(len(breaks))]

    def words_before(i: int) -> tuple[str, str]:
        out = []
        while i >= 0 and len(out) < 2:
            if tokens[i][0] not in ("sp", "nl", "close", "open"):
                out.append(_left(tokens[i][0], text[tokens[i][1] : tokens[i][2]]))
            i -= 1
        return (*out, "^", "^")[:2]

    def words_after(i: int) -> tuple[str, str]:
        out = []
        while i < n and len(out) < 2:
            if tokens[i][0] not in ("sp", "nl"):
                out.append(_right(tokens[i][0], text[tokens[i][1] : tokens[i][2]]))
            i += 1
        return (*out, "$", "$")[:2]

    inside = _enclosed(text, tokens) or [False] * n
    found: list[Candidate] = []
    line, line_start = 0, 0
    # Only marks, line breaks and blanks beside Thai may end a unit; words between them are counted.
    places = [i for i, t in enumerate(tokens) if t[0] == "end" or t[0] == "nl" or t[0] == "thai"]
    if len(places) > len(breaks) and any(tokens[i][0] == "thai" for i in places):
        beside = {j for i in places if tokens[i][0] == "thai" for j in (i - 1, i + 1) if 0 < j < n - 1 and tokens[j][0] == "sp"}
        places = sorted(beside.union(i for i in places if tokens[i][0] != "thai"))
    words = [*accumulate((t[0] not in _NO_WORD for t in tokens), initial=0)]
    base, done = 0, 0
    for i in places:
        if i < done:
            continue
        kind, a, b = tokens[i]
        since = words[i] - base
        if kind == "end":
            j = i + 1
            while j < n and tokens[j][0] == "close" and tokens[j][1] == tokens[j - 1][2]:
                j += 1
            mark = text[a : tokens[j - 1][2]]
            before, after = text[a - 1 : a], text[tokens[j - 1][2] : tokens[j - 1][2] + 1]
            l1, l2 = mark[0] * min(3, len(mark.rstrip("\"'”’」』）)]】》»〉＂>"))) + ("”" if j > i + 1 else ""), words_before(i - 1)[0]
            done = j
            if j == n or tokens[j][0] == "nl":
                if j < n:
                    since += 1
                    tokens_nl = tokens[j]
                    at = _break(text, tokens_nl, line, forced, wrapped, l2, l1, words_after(j + 1), "b", since)
                    goes_on = at.known is None and before.isdigit() and _GOES_ON.match(text, tokens_nl[2])
                    found.append(at._replace(known=0) if goes_on else at)
                    line, line_start, done = line + 1, tokens_nl[2], j + 1
                    base = words[j]
                continue
            spaced = tokens[j][0] == "sp"
            known = None
            if not spaced and mark[0] in ".．!?" and len(mark) == 1 and (before.isascii() and before.isalnum() or before.isdigit()) and (after.isascii() and (after.isalnum() or after in "/@&=_-:,") or after.isdigit()):
                known = -1  # inside a number, an address or a name
            elif not spaced and after and (after in ",;:،、，；：·~%" or tokens[j][0] == "mark" and after not in "※■▶•○①"):
                known = -1
            elif inside[j - 1] or _LABEL.match(text[line_start : tokens[j - 1][2]]):
                known = 0  # within brackets or quotes, or the label of a list item
            elif _GOES_ON.match(text, tokens[j - 1][2]) and before.isdigit():
                known = 0  # a date goes on with its weekday or its end
            if known != -1:
                r1, r2 = words_after(j)
                start = tokens[j][2] if spaced else tokens[j - 1][2]
                found.append(Candidate(tokens[j - 1][2], start, "P" if spaced else "p", known, l2, l1, r1, r2, since <= 1))
                base = words[j]
            continue
        if kind == "nl":
            l1, l2 = words_before(i - 1)
            found.append(_break(text, tokens[i], line, forced, wrapped, l2, l1, words_after(i + 1), "B", since))
            line, line_start = line + 1, b
            base = words[i]
        elif tokens[i + 1][0] not in ("close", "end"):
            r1, r2 = words_after(i + 1)
            l1, l2 = words_before(i - 1)
            # Nothing ends after a mark that leads on, or within brackets and quotes.
            known = 0 if inside[i] or text[a - 1] in ":,;،-–/" else None
            found.append(Candidate(a, b, "T", known, l2, l1, r1, r2, since <= 1))
            base = words[i]
    return found


def _break(text: str, token: tuple[str, int, int], line: int, forced: list[bool], wrapped: bool, l2: str, l1: str, right: tuple[str, str], kind: str, since: int) -> Candidate:
    """The candidate at a line break; known to end a unit unless the line may be broken within a sentence."""
    raw = text[token[1] : token[2]]
    known = 1 if len(_EOL.findall(raw)) > 1 or not wrapped or forced[line] or _LEAD.match(text, token[2]) else None
    # Undecided breaks without a mark are a kind of their own: the known ones, mostly boundaries, say nothing about their share.
    return Candidate(token[1], token[2], "W" if kind == "B" and known is None else kind, known, l2, l1, *right, since <= 1)


def _script(word: str) -> str:
    """The script of a word's first letter, as one character."""
    c = word[:1]
    if c.isdigit():
        return "0"
    if not c.isalpha():
        return "M"
    for name, low, high in _SCRIPTS:
        if low <= c <= high:
            return name
    return "L"


#: Ranges of the scripts that differ in how they mark sentences; all other letters count as Latin.
_SCRIPTS = (("H", "가", "힣"), ("T", "฀", "๿"), ("T", "\u0e80", "\u0eff"), ("T", "\u1780", "\u17ff"), ("T", "\u1000", "\u109f"), ("D", "ऀ", "ॿ"), ("A", "؀", "ۿ"), ("C", "぀", "ヿ"), ("C", "㐀", "鿿"))


#: A candidate as it is stored: trimmed end and start, kind, known event (-1: none), marks, and the hashes of its n-grams. The first
#: record of a text holds where its first unit starts and its last one ends.
_RECORD = np.dtype([("end", "<i4"), ("start", "<i4"), ("kind", "i1"), ("known", "i1"), ("marks", "u1"), ("grams", "<u8", 7)])
KINDS = "PpTBWb"
_HEAD = -1
#: Marks: at most one word since the last candidate; the next word is a number; the words around speak against a boundary.
_NEAR, _NUMBER, _AGAINST = 1, 2, 4
#: Places of the n-grams: the kind; with the word before; with two; the word after; with its successor; the nearness; the unit's end.
_K, _ONE, _TWO, _NEXT, _AFTER, _NEARNESS, _END = range(7)
_ALL = np.uint64(0x9E3779B97F4A7C15)


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its code, the distinct words)."""
    codes, unique = pd.factorize(np.array(words, object))
    return pd.util.hash_array(unique, categorize=False)[codes], codes, unique


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of a kind with these parts."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (kind + 3) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _records(texts: list[str]) -> list[np.ndarray]:
    """The records of each text: its head and its candidates."""
    found = [candidates(t) for t in texts]
    flat = [c for cands in found for c in cands]
    out = np.zeros(len(flat), _RECORD)
    if flat:
        kind = np.array([KINDS.index(c.kind) for c in flat])
        out["kind"], out["known"] = kind, [-1 if c.known is None else c.known for c in flat]
        (l1, l1_code, l1_words), (l2, l2_code, l2_words), (r1, r1_code, r1_words), (r2, _, _) = (_hashed([getattr(c, f) for c in flat]) for f in ("l1", "l2", "r1", "r2"))
        of = lambda words, codes, test: np.array([test(w) for w in words], bool)[codes]
        scripts = np.array([ord(_script(w)) for w in r1_words])[r1_code]
        number, after_number = of(r1_words, r1_code, lambda w: w == "0"), of(l2_words, l2_code, lambda w: w == "0")
        small = of(r1_words, r1_code, lambda w: w[:1].islower())
        is_, near = lambda *names: np.isin(kind, [KINDS.index(n) for n in names]), np.array([c.near for c in flat])
        # Small letters go on, names within Thai too, and a number after a number's period.
        against = (scripts == ord("L")) & (is_("T") | small) | number & after_number & of(l1_words, l1_code, lambda w: w == ".")
        out["marks"] = near * _NEAR + number * _NUMBER + against * _AGAINST
        # Marks of any place count as one kind; Thai lines end as sentences between blanks do, so their known ends tell about these.
        group = np.where(is_("P", "p", "b"), 0, np.where(is_("B") & (scripts == ord("T")), KINDS.index("T"), kind))
        k = (group * 256 + scripts).astype(np.uint64)
        # A number after a number's period and one after a word's are different things.
        first = np.where(number & after_number, r1 + np.uint64(1), r1)
        grams = out["grams"]
        grams[:, _K], grams[:, _ONE], grams[:, _TWO] = _mixed(_K, k), _mixed(_ONE, k, l1), _mixed(_TWO, k, l1, l2)
        grams[:, _NEXT], grams[:, _AFTER], grams[:, _NEARNESS] = _mixed(_NEXT, first), _mixed(_AFTER, first, r2), _mixed(_NEARNESS, k, near)
        # What a unit ends with, whatever follows: the last word, or the mark and the word before it.
        grams[:, _END] = np.where(is_("B", "T", "W"), _mixed(_END, l1), _mixed(_END, l1, l2))
    result, at = [], 0
    for text, cands in zip(texts, found, strict=True):
        rows = np.zeros(len(cands) + 1, _RECORD)
        rows[1:] = out[at : at + len(cands)]
        at += len(cands)
        rows["start"] = [_skip(text, 0), *(_skip(text, c.start) for c in cands)]
        rows["end"] = [_back(text, len(text)), *(_back(text, c.end) for c in cands)]
        rows["kind"][0] = _HEAD
        result.append(rows)
    return result


def _skip(text: str, at: int) -> int:
    """The first place from `at` without white space or a byte-order mark."""
    while at < len(text) and (text[at] in _SPACE or text[at].isspace()):
        at += 1
    return at


def _back(text: str, at: int) -> int:
    """The last place up to `at` after something other than white space or a byte-order mark."""
    while at > 0 and (text[at - 1] in _SPACE or text[at - 1].isspace()):
        at -= 1
    return at


def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of n-grams in both tables, which stand one behind the other."""
    low = np.uint64(SLOTS - 1)
    return (grams & low).astype(np.int64), ((grams >> np.uint64(32)) & low).astype(np.int64) + SLOTS


class Model(NamedTuple):
    """Counts of n-grams by counter with the boundary event (b) and without (n); seed: n counts the undecided places instead."""

    b: np.ndarray
    n: np.ndarray
    seed: bool = False

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(0, np.float32), np.zeros(0, np.float32))

    def counts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.b):
            return np.zeros(grams.shape), np.zeros(grams.shape)
        one, two = _slots(grams)
        at = np.where(self.b[one] + self.n[one] <= self.b[two] + self.n[two], one, two)
        return self.b[at].astype(np.float64), self.n[at].astype(np.float64)


class Packed(NamedTuple):
    """A model as it is sent: the counters that are not zero, with their places."""

    slot: np.ndarray
    b: np.ndarray
    n: np.ndarray
    seed: bool

    def model(self) -> Model:
        b, n = np.zeros(2 * SLOTS, np.float32), np.zeros(2 * SLOTS, np.float32)
        b[self.slot], n[self.slot] = self.b, self.n
        return Model(b, n, self.seed)


def packed(model: Model) -> Packed:
    slot = np.flatnonzero(model.b + model.n).astype(np.int32)
    return Packed(slot, model.b[slot], model.n[slot], model.seed)


def log_odds(model: Model, rows: np.ndarray) -> np.ndarray:
    """log P(event, following words | preceding words) with a boundary over without, by interpolated n-grams, of each record."""
    b, n = model.counts(rows["grams"].T)
    number, against = rows["marks"] & _NUMBER > 0, rows["marks"] & _AGAINST > 0
    if model.seed:
        # From known boundaries alone: whether the words around are ever seen at one, against how often at undecided places.
        prior = np.array([SEED_PRIOR[k] for k in KINDS])[rows["kind"]]
        out = np.log(prior / (1 - prior))
        for key, never in ((_NEXT, 2.0), (_END, 3.0)):
            at, other = b[key], n[key]
            seen = np.where((at >= 2) & (at >= 0.02 * (at + other)), 2.0, np.where((other >= 20) & (at < 0.005 * (at + other)), -never, 0.0))
            # A number begins list items, but seldom sentences.
            out += np.where(number, -2.0, seen) if key == _NEXT else seen
        return out - 3.0 * against
    share = lambda key, base, weight: (b[key] + weight * base) / (b[key] + n[key] + weight)
    p = share(_TWO, share(_ONE, share(_K, 0.5, 2.0), 2.0), 2.0)
    all_b, all_n = (float(x[0]) + 1.0 for x in model.counts(np.array([_ALL])))
    # The next word as one that begins a unit over one that goes on; then its successor given the word.
    u, v = 1e-4, 0.05
    first = ((b[_NEXT] / all_b + u) / (1 + u)) / ((n[_NEXT] / all_n + u) / (1 + u))
    then = ((b[_AFTER] + v * 4) / (b[_NEXT] + 4)) / ((n[_AFTER] + v * 4) / (n[_NEXT] + 4))
    return np.clip(np.log(p / (1 - p)) + np.log(first) + np.log(then), -25.0, 25.0)


def posteriors(model: Model, rows: np.ndarray) -> np.ndarray:
    """P(boundary) of each record by the forward-backward algorithm over the two events; 0 at the heads of texts.

    Neighbouring candidates are coupled where at most one word lies between them: two boundaries so close make a unit of one
    word, which is as rare as the model has seen it. Other neighbours are independent given the words, so the algorithm runs
    over chains of coupled ones, all chains of a batch at once.
    """
    if not len(rows):
        return np.zeros(0)
    head, known = rows["kind"] == _HEAD, rows["known"]
    odds = np.where(known == 0, -25.0, np.where(known == 1, 25.0, log_odds(model, rows)))
    local = np.where(head, 0.0, 1 / (1 + np.exp(-odds)))
    b, n = model.counts(rows["grams"][:, _NEARNESS])
    # A seed knows nothing yet about units of one word.
    tied = (not model.seed) & (rows["marks"] & _NEAR > 0) & (known < 0) & ~head & ~np.concatenate([[True], head[:-1]])
    pair = np.where(tied, np.clip((b + 0.1) / (b + n + 1.0), 0.02, 1.0), 1.0)
    out = local.copy()
    first = np.flatnonzero(~tied & np.concatenate([tied[1:], [False]]))  # where a chain begins
    if not len(first):
        return out
    ends = np.flatnonzero(tied & ~np.concatenate([tied[1:], [False]]))
    length = ends - first + 1
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    forward = []
    for j in range(int(length[0])):
        m = int(np.searchsorted(-length, -j, side="left"))  # chains longer than j
        at = first[:m] + j
        if j == 0:
            f0, f1 = 1 - local[at], local[at]
        else:
            g0, g1 = forward[-1][0][:m], forward[-1][1][:m]
            f0, f1 = (g0 + g1) * (1 - local[at]), (g0 + g1 * pair[at]) * local[at]
        z = f0 + f1
        z = np.where(z > 0, z, 1.0)
        forward.append((f0 / z, f1 / z))
    back0, back1 = np.ones(len(first)), np.ones(len(first))
    for j in range(int(length[0]) - 1, -1, -1):
        m = len(forward[j][0])
        at = first[:m] + j
        p0, p1 = forward[j][0] * back0[:m], forward[j][1] * back1[:m]
        out[at] = np.where(p0 + p1 > 0, p1 / np.where(p0 + p1 > 0, p0 + p1, 1.0), local[at])
        if j:
            n0 = (1 - local[at]) * back0[:m] + local[at] * back1[:m]
            n1 = (1 - local[at]) * back0[:m] + pair[at] * local[at] * back1[:m]
            z = np.where(n0 + n1 > 0, n0 + n1, 1.0)
            back0[:m], back1[:m] = n0 / z, n1 / z
    return out


def _units(rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, end) of the units of texts, in order."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    head = rows["kind"] == _HEAD
    cut = head | (p > 0.5)
    text, start, end = (np.cumsum(head) - 1)[cut], rows["start"][cut], rows["end"][cut]
    heads = np.flatnonzero(head[cut])
    # A head holds the end of its text's last unit, a boundary that of the unit before it.
    ends = np.roll(end, -1)
    ends[np.concatenate([heads[1:], [len(end)]]).astype(np.int64) - 1] = end[heads]
    ok = start < ends
    return text[ok], start[ok], ends[ok]


def sentence_spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text in code points, without white space or byte-order marks at their ends."""
    if not text:
        return []
    rows = _records([text])[0]
    _, start, end = _units(rows, posteriors(model, rows))
    return [*zip(start.tolist(), end.tolist(), strict=True)]


def candidate_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, records: all places of each text where the model decides, read once and written to the shared folder.

    Null and empty texts have no row; a blank one has its head only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [r.tobytes() for r in _records(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "records"])

    rows = docs.select("doc_id", F.col(text).alias("text")).filter(F.length("text") > 0)
    # Texts differ in length: over more parts than cores, the longest ones do not keep one task behind the others.
    return materialized(fan_out(rows, "doc_id").mapInArrow(read, "doc_id long, records binary"))


def _joined(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("records").to_pylist()), _RECORD)


def _expected(model: Broadcast | None):  # noqa: ANN202
    """slot, b, no of the n-grams of all records of a task: expected counts with the boundary event and without."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = None if model is None else model.value.model()
        b, no = np.zeros(2 * SLOTS), np.zeros(2 * SLOTS)
        for batch in batches:
            rows = _joined(batch)
            # The first pass sets known boundaries against undecided places; labels, known to be none, join in the second.
            p = (rows["known"] == 1).astype(np.float64) if told is None else posteriors(told, rows)
            q = (rows["known"] < 0).astype(np.float64) if told is None else 1.0 - p
            real = rows["kind"] != _HEAD
            grams, p, q = rows["grams"][real], p[real], q[real]
            for at in _slots(_ALL):
                b[at] += p.sum()
                no[at] += q.sum()
            slots = np.concatenate([x.ravel() for x in _slots(grams)])
            b += np.bincount(slots, np.tile(np.repeat(p, grams.shape[1]), 2), len(b))
            no += np.bincount(slots, np.tile(np.repeat(q, grams.shape[1]), 2), len(b))
        at = np.flatnonzero(b + no)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(b[part]), pa.array(no[part])], ["slot", "b", "no"])

    return count


def train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all documents (candidate_table), by expectation-maximisation.

    Known events (blank lines, list items, lines that had room for the next word, labels) seed it; the others start undecided.
    Each round is one pass over the stored candidates: forward-backward posteriors in numpy, summed by slot within each task,
    then by counter over all tasks. At most 2 SLOTS rows reach the driver and go out again as a broadcast.
    """
    spark, model = table.sparkSession, None
    for _ in range(rounds):
        shared = None if model is None else spark.sparkContext.broadcast(packed(model))
        sums = table.select("records").mapInArrow(_expected(shared), "slot int, b double, no double").groupBy("slot").agg(F.sum("b").alias("b"), F.sum("no").alias("no"))
        rows = sums.filter(F.col("b") + F.col("no") >= MIN_COUNT - 1e-6).select("slot", F.col("b").cast("float"), F.col("no").cast("float")).toArrow()
        b, no = np.zeros(2 * SLOTS, np.float32), np.zeros(2 * SLOTS, np.float32)
        if shared is not None:
            shared.destroy()
        b[rows["slot"].to_numpy()], no[rows["slot"].to_numpy()] = rows["b"].to_numpy(), rows["no"].to_numpy()
        model = Model(b, no, model is None)
    return model or Model.empty()


def split_sentences(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, sent_start, sent_end: the sentence units of every document of a candidate_table; empty and blank texts have none."""
    shared = table.sparkSession.sparkContext.broadcast(packed(model))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value.model()
        for batch in batches:
            rows = _joined(batch)
            text, start, end = _units(rows, posteriors(told, rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "sent_start", "sent_end"])

    return table.mapInArrow(split, "doc_id long, sent_start int, sent_end int")
