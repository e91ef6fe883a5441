"""Personal data: base patterns and a skip-chain conditional random field.

Base spans come from patterns with checks (IPv4 parts, Luhn, digit counts).
Matching is anchored at ``@`` signs and digit runs, which gives the leftmost
non-overlapping matches in linear time for any text.

The field's nodes are the base spans (observed) and the other tokens with an
``@`` or at least ``LEAST_DIGITS`` digits. Edges join neighbours in the text
and, as skip edges, each token to the next one of a similar form (equal last
seven digits, equal mailbox) or of the same one (equal text, equal digits).
Node weights (of shape features) and the strength of each kind of edge are
fitted together by pseudo-likelihood on base spans of a bounded sample of
documents (``SAMPLE_ROWS``). Tokens linked to a base span have no known label
and stay out of the fit; all others are negatives. Base spans with a skip edge
count a second time with their shape hidden, so that edges learn what a label
at the other end tells. Damped loopy max-product passes messages until they
settle or ``ROUNDS`` is reached. A token that ends with an entity label, and
with a skip edge to a token of that label, becomes an extra span; base spans
stay. Texts without skip edges cannot get extra spans, so the field is not
built for them; nothing else is left out.

Spans are code point offsets, end exclusive. Defined results: null texts are
empty and have no spans; whole texts of any length are scanned and make one
field; spans that start together are in the order of kinds, equal beliefs take
the first label; other columns are dropped; repeated rows are scanned row by
row; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, map_rows

KINDS = ("email", "ip", "card", "phone")
#: Rows from which the node potentials are fitted.
SAMPLE_ROWS = 2_000
ROUNDS = 30
#: Digits from which a token is a node of the field.
LEAST_DIGITS = 4
#: Kinds of edges: neighbours, similar forms, same form.
CHAIN, SIMILAR, SAME = range(3)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_TRIM = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _RUN.search(text):
        done = 0
        for run in _RUN.finditer(text):
            if run.start() >= done and (m := _IP.match(text, run.start())):
                done = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((m.start(), 1, done))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def nodes(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end): base spans with their label, other tokens with label 0."""
    base = base_spans(text)
    taken = [(s, e) for s, _, e in base]
    out, i, reach = [(s, k + 1, e) for s, k, e in base], 0, 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        start = m.start() + len(word) - len(word.lstrip(_TRIM))
        end = m.end() - (len(word) - len(word.rstrip(_TRIM)))
        while i < len(taken) and taken[i][0] < m.end():
            reach, i = max(reach, taken[i][1]), i + 1
        if start < end and reach <= start and ("@" in word or sum(c.isdigit() for c in word) >= LEAST_DIGITS):
            out.append((start, 0, end))
    return sorted(out)


def features(word: str) -> list[float]:
    """Shape of a token: what the node weights see, the checks of the base patterns among it."""
    figures = "".join(c for c in word if c in "0123456789")
    digits, parts = len(figures), word.split(".")
    return [
        1.0, float("@" in word), float("." in word), float(len(parts) == 4), digits / max(1, len(word)), float(10 <= digits <= 15), float(14 <= digits <= 19), float(word[:1] == "+"), float(digits == 0), float(any(c.isalpha() for c in word)), float(digits < 7),
        float(14 <= digits <= 19 and _luhn(figures)), float(14 <= digits <= 19 and not _luhn(figures)), float(len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)),
    ]


class Field(NamedTuple):
    """Node weights (labels x features) and the strength of each kind of edge."""

    weights: np.ndarray
    strengths: np.ndarray


def fit(rows: list[str], steps: int = 400, decay: float = 0.02) -> Field:
    """The field of highest pseudo-likelihood on the base spans of texts.

    Every label gets the same total weight, and full-batch descent makes the fit deterministic.
    """
    x, y, near = [], [], []  # features, label, labels at the other ends by kind of edge

    def add(shape: list[float], label: int, told: np.ndarray) -> None:
        x.append(shape)
        y.append(label)
        near.append(told)

    blank = features("")[:1] + [0.0] * (len(features("")) - 1)
    for text in rows:
        own = nodes(text)
        links = edges(text, own)
        guessed = {i for pair, kind in links.items() if kind != CHAIN and any(own[k][1] for k in pair) for i in pair if not own[i][1]}
        told = np.zeros((len(own), 5, 3))
        for (i, j), kind in links.items():
            for here, there in ((i, j), (j, i)):
                if there not in guessed:
                    told[here, own[there][1], kind] += 1
        for i, (start, label, end) in enumerate(own):
            if i not in guessed:
                add(features(text[start:end]), label, told[i])
                if label and told[i, :, 1:].any():
                    add(blank, label, told[i])
    # Prior examples, one for twenty of their label, keep labels and edges that the sample does not show defined.
    held = np.bincount(np.array(y, int), minlength=5)
    for label, word in enumerate(("1234", "ab.1@mail.example.com", "10.20.30.40", "4000000000000002", "+1 (555) 555-0100")):
        for _ in range(1 + held[label] // 20 if label else 1):
            add(features(word), label, np.zeros((5, 3)))
            for kind in (SIMILAR, SAME) if label else ():
                told = np.zeros((5, 3))
                told[label, kind] = 1
                add(blank, label, told)
    x, y, near = np.array(x, float), np.array(y), np.array(near)
    share = (len(y) / np.bincount(y, minlength=5).clip(1) / 5)[y][:, None] / len(y)
    w, power, hot = np.zeros((5, x.shape[1])), np.zeros(3), np.eye(5)[y]
    for _ in range(steps):
        z = x @ w.T + near @ power
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - hot) * share
        w -= 2.0 * (off.T @ x + decay * w / 5)
        power = np.maximum(power - 2.0 * (np.einsum("nl,nlk->k", off, near) + decay * power / 5), 0)
    return Field(w, power)


def forms(word: str) -> list[tuple[str, int]]:
    """Keys that make tokens the same or similar, with their kind of edge."""
    digits = "".join(c for c in word if c.isdigit())
    keys = [(f"w:{word.lower()}", SAME)]
    if len(digits) >= 7:
        keys += [(f"d:{digits}", SAME), (f"t:{digits[-7:]}", SIMILAR)]
    if "@" in word[1:]:
        keys.append((f"m:{word.lower().split('@')[0]}", SIMILAR))
    return keys


def edges(text: str, own: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """The strongest kind of edge of each pair of nodes that has one."""
    last: dict[str, int] = {}
    found: dict[tuple[int, int], int] = {}
    for i, (start, _, end) in enumerate(own):
        if i:
            found[i - 1, i] = CHAIN
        for key, kind in forms(text[start:end]):
            if key in last:
                pair = (last[key], i)
                found[pair] = max(kind, found.get(pair, kind))
            last[key] = i
    return found


def settle(unary: np.ndarray, edges: np.ndarray, strength: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Labels by damped loopy max-product; edges are (i, j) pairs, both ways here."""
    if not len(edges):
        return unary.argmax(1)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    power, back = np.concatenate([strength, strength])[:, None], np.roll(np.arange(2 * len(edges)), len(edges))
    sent = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, sent)
        out = belief[src] - sent[back]
        # Potts potential: keep the label's own score plus the bonus, or the best other.
        out = np.maximum(out + power, out.max(1, keepdims=True))
        out = 0.5 * sent + 0.5 * (out - out.max(1, keepdims=True))
        moved, sent = np.abs(out - sent).max(), out
        if moved < 1e-6:
            break
    belief = unary.copy()
    np.add.at(belief, dst, sent)
    return belief.argmax(1)


def find(text: str, field: Field, rounds: int = ROUNDS) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, is base) of all spans, by start, then kind."""
    if not _RUN.search(text) and "@" not in text:
        return []
    own = nodes(text)
    spans = [(s, k - 1, e, True) for s, k, e in own if k]
    if len(spans) == len(own):
        return spans
    links = edges(text, own)
    if all(kind == CHAIN or (own[i][1] and own[j][1]) for (i, j), kind in links.items()):
        return spans  # no token that could become a span
    unary = np.array([features(text[s:e]) for s, _, e in own]) @ field.weights.T
    for i, (_, k, _) in enumerate(own):
        if k:
            unary[i], unary[i, k] = -50.0, 50.0
    pairs, kinds = np.array(list(links), int), np.array(list(links.values()))
    labels = settle(unary, pairs, field.strengths[kinds], rounds)
    # An extra span needs a skip edge to a node of the same label.
    backed = {i for pair, kind in links.items() if kind != CHAIN and labels[pair[0]] == labels[pair[1]] for i in pair}
    spans += [(s, int(labels[i]) - 1, e, False) for i, (s, k, e) in enumerate(own) if not k and labels[i] and i in backed]
    return sorted(spans)


def _field(docs: DataFrame, text_col: str, sample_rows: int) -> Field:
    found = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000)).select("text", F.xxhash64("text").alias("h"))
    # The cut is found on distinct hashes, so texts above it never leave their tasks.
    cut = found.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    chosen = found.where(F.col("h") <= cut).dropDuplicates(["h"]) if cut is not None else found.limit(0)
    return fit([r["text"] for r in chosen.orderBy("h").collect()])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Id, text and ``found``: array of (start, kind, end, base) of every row.

    Only the field is fitted on a sample: rows with a digit or ``@``
    of under 20,000 characters, at most ``sample_rows``, those with the
    smallest hash of their text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    field = _field(source, "text", sample_rows)
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())])
    out = pa.schema([("id", pa.int64()), ("text", pa.string()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = [[dict(zip(("start", "kind", "end", "base"), x, strict=True)) for x in find(t.as_py(), field, rounds)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(spans, out.field("found").type)], schema=out)

    return source.mapInArrow(run, "id bigint, text string, found array<struct<start:bigint,kind:int,end:bigint,base:boolean>>").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each group of overlapping spans replaced by its first ``<KIND>``."""
    parts, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` with their columns and masked texts; null texts stay null."""
    field, at = _field(docs, text_col, sample_rows), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([t and masked(t, find(t, field, rounds)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return map_rows(docs, run)


def span_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base kinds, digest of base spans and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def _of_kind(k: int):
    return F.filter("found", lambda s: s["base"] & (s["kind"] == k))
