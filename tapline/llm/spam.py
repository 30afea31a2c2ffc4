"""Keyword-stuffed pages, link lists and product-tag lists in place of text.

The terms of a text are a sequence of positions. Its autocorrelation at a lag is the share of content words whose
term also stands exactly that many words before; summed over the lags up to ``LAG`` it is the mass of regular
repetition. In prose it is the function words that return, and the mass of content words stays far below ``MASS``;
pages of repeated keywords, links or tags lie above it. A text below has no repetition that counts.

Which words take part is told unit by unit (lines, and sentences within a line), from the recurrence gaps to the
previous and next occurrence of the same term and from the share of function words. Lists of many distinct nouns or
links repeat nothing and are told by having hardly any function words: of all such units of a text together, the
share of words that did not occur shortly before. Log lines, rows of tables and command lines are told from lists by
what they are made of: at least two, and an eighth of the words, are addresses, times, settings, options, paths or
levels. Marks around a text, such as fences, exempt nothing. A document is reported if the greater part of its words
stands in such units.

Every document is judged by itself, whole, in one pass without a shuffle. The decision uses fixed, documented
thresholds that were set on labelled documents; no limit depends on the size of the data.

Edge cases: null and empty texts, and texts without words, are not cases; ties (exactly half) are not cases; a
text of any length is used whole; repeated documents give repeated rows; an empty table gives an empty result;
only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapline.session import spread

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z]+\b")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")
# Frequent function words of English, German, French and Spanish.
FUNCTION = frozenset(
    """a about after again against all also although an and any are as at be because been before being between but by can could did do does
    each for from had has have he her his how i if in into is it its just many may most my no nobody nor not of off on once one only or
    other our out over own same she should since so some such than that the their them then there these they this those though through to too two under
    unless until up very was we were what when where which while who whom whose why will with would yet you your
    aber alle als am an auch auf aus bei bis da das dass dem den denn der des deren deshalb die dies diese dieser doch durch ein eine einem einen einer es
    für gibt hat habe haben ich ihm ihr im in ist ja jede jeder kann kein keine man mit nach nicht nichts noch nur ob obwohl oder ohne sich sie sind so über um
    und uns unter vom von vor wann war waren was weil wenn wer werden wie wir wird wo wurde wurden zu zum zur zwei zwischen
    au aux avec car ce ces cette chez comme dans de depuis des deux dont du elle en entre est et être il ils je la le les leur lui mais même moins ne nous on
    ont ou où par pas plus pour quand que qui rien sa sans se ses si son sont sous sur un une vers vous y
    al antes con como cuando de del desde donde dos el ella en entre era es esa ese esta este están está fue ha han hasta hay la las lo los más mi muy nada
    ni no nos o para pero por porque que se según ser si sin sobre son su sus también todo un una y ya""".split()
)
# What machines write, between blanks: addresses, times, settings, options, paths, levels, protocols.
MACHINE = re.compile(
    r"""[^\w/~=.-]*(?:\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|\d{4}-\d\d-\d\d(?:T\d\d:\d\d|$)|[A-Za-z_][\w.-]*=[^"'\s]|--?[A-Za-z][\w-]*(?:=|$)|~?\.{0,2}(?:/[\w.-]+)+/?$"""
    r"""|(?:DEBUG|INFO|WARN|WARNING|ERROR|tcp|udp)$)"""
)
LAG = 40  # words within which a returning term counts as repetition, and lags over which the autocorrelation is summed
MASS = 0.45  # mass of the autocorrelation from which repetition is not that of prose
TIGHT = 8  # the same in sentences, where whole sentences may well return later
DISTINCT = 0.5  # share of the words of bare units that did not occur within the lag before, from which they list distinct nouns
LISTED = 20  # words such a list has at least
STEM = 7  # letters that variations of a keyword share
UNIT = 40  # words after which a unit without a break is cut


class _Numbers(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def is_technical(line: str) -> bool:
    made = sum(map(bool, map(MACHINE.match, line.split())))
    return made >= 2 and 8 * made >= len(WORD.findall(line))


def units_of(text: str) -> Iterator[tuple[str, bool]]:
    """(unit, technical) in order."""
    for line in text.split("\n"):
        if not line.strip():
            continue
        if is_technical(line):
            yield line, True
        else:
            for part in SENTENCE.split(line):
                yield part, False


def autocorrelation(code: np.ndarray, lags: int = LAG) -> np.ndarray:
    """For each lag from 1 on the number of positions whose code also stands that many places before; negative codes
    stand for places that are left out."""
    at = np.flatnonzero(code >= 0)
    at = at[np.argsort(code[at], kind="stable")]
    code, found = code[at], np.zeros(lags, dtype=np.int64)
    for k in range(1, lags + 1):  # the k-th occurrence before, until none lies within reach
        apart = at[k:] - at[:-k]
        apart = apart[(code[k:] == code[:-k]) & (apart <= lags)]
        if not len(apart):
            break
        found += np.bincount(apart, minlength=lags + 1)[1:]
    return found


def spam_share(text: str | None) -> tuple[float, float]:
    """The share of words that stands in repeated keywords, links or tags; the mass of the autocorrelation."""
    if not text:
        return 0.0, 0.0
    words: list[str] = []
    bounds, technical = [0], []
    for unit, tech in units_of(text):
        w = WORD.findall((TAG.sub(" ", unit) if "<" in unit else unit).lower())
        if not w:
            continue
        for k in range(0, len(w), UNIT):
            words += w[k : k + UNIT]
            bounds.append(len(words))
            technical.append(tech)
    n = len(words)
    if not n:
        return 0.0, 0.0
    seen, stems = _Numbers(), _Numbers()
    code = np.array([seen[w] for w in words])
    func = np.array([w in FUNCTION for w in seen])[code]
    content = ~func & ~np.array([w.isdigit() for w in seen])[code]
    # Variations of a keyword, with a number or another word appended, are one term.
    code = np.array([stems[t.rstrip("0123456789")[:STEM] or t] for t in seen])[code]
    edge = np.array(bounds)
    size = edge[1:] - edge[:-1]
    sums = lambda x: np.add.reduceat(x, edge[:-1], dtype=np.int64)
    c, share_f, plain = sums(content), sums(func) / size, ~np.array(technical)
    counted = content & np.repeat(plain, size)
    mass = float(autocorrelation(np.where(counted, code, -1)).sum() / max(1, counted.sum()))
    bare = plain & (share_f <= 0.08) & (2 * c >= size)
    if mass < MASS and c[bare].sum() < LISTED:
        return 0.0, mass
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    gap = np.where(same, order[1:] - order[:-1], n + LAG)
    back, ahead = np.full(n, n + LAG), np.full(n, n + LAG)
    back[order[1:]], ahead[order[:-1]] = gap, gap
    nearest = np.minimum(back, ahead)
    r, tight = (sums(content & (nearest <= lag)) / np.maximum(c, 1) for lag in (LAG, TIGHT))
    listed = (share_f <= 0.08) & (r >= 0.3) | (share_f <= 0.16) & (r >= 0.55)
    dressed = (tight >= 0.5) & (c >= 3)
    fresh = sums(content & (back > LAG))[bare].sum()
    distinct = bare & (fresh >= DISTINCT * c[bare].sum()) & (c[bare].sum() >= LISTED)
    hits = plain & (listed | dressed) | distinct if mass >= MASS else distinct
    return float(size[hits].sum() / n), mass


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [spam_share(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in shares], pa.float64()), pa.array([m for _, m in shares], pa.float64())], names=["doc_id", "share", "mass"])


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, share, mass) of every document."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_judge, "doc_id bigint, share double, mass double")


def spam_pages(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id) of the documents the greater part of which is spam."""
    return scored(documents).filter(f"share > {float(share)}").select("doc_id")
