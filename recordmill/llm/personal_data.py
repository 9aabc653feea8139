"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns give the base spans, which always stay. The field looks at islands: runs of words
with a digit, an ``@`` or an ``at`` in brackets, with at most one word between them and one on either
side; all ways of writing an entity that it is trained on have one of these marks. An island is cut into
units (letters, digits, single signs). Every run of up to ``LONGEST`` units and ``REACH`` characters with a mark
is a candidate segment, scored by features of the whole span; a dynamic program chooses boundaries and kinds
together, and what does not overlap a base span is added. The patterns are searched in time linear in the text.

The field is trained by likelihood on at most ``TRAIN_ISLANDS`` islands of at most ``TRAIN_DOCS`` documents, where
base spans are the entities, on copies of these islands with an entity written in another of the ways people
write it, which the patterns do not match, and on copies with an address that has lost its dots, which is
none. Training islands have at most ``TRAIN_LENGTH`` characters and ``TRAIN_UNITS`` units; scoring has no such bound.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.text import received, sent

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Searched in place of the patterns, with the same matches: an address is found from its ``@``, and a group of digits
#: that follows a digit starts no match that its whole run does not.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile("(?<![0-9])" + IP.pattern)

LONGEST = 16
REACH = 320
FEATURES = 1 << 13
TRAIN_DOCS = 3000
TRAIN_ISLANDS = 1500
TRAIN_LENGTH = 1000
TRAIN_UNITS = 80
EPOCHS = 6
WINDOW = 2048

Span = tuple[int, int, int]  # start, end, kind

SIGNAL = re.compile(r"[0-9@]")
AT = re.compile(r"[(\[{]at[)\]}]", re.IGNORECASE)
ADDRESS = re.compile(rf"[\w.%+-]+\s?(@|{AT.pattern})\s?{HOST.pattern}", re.IGNORECASE)
MARK = re.compile(f"{SIGNAL.pattern}|{AT.pattern}", re.IGNORECASE)
UNIT = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``EMAIL``, each from its ``@``."""
    at, low = text.find("@"), 0
    while at >= 0:
        local = text[low:at]
        start = low + len(local.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold their check, by start and kind."""
    if not SIGNAL.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP_RUN.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text)
              if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def islands(text: str) -> list[tuple[int, int]]:
    """Where entities can be: marked words with at most one word between them, and one word on either side."""
    found: list[tuple[int, int]] = []
    inside = False  # the last word was marked
    before = 0  # where it starts
    for word in WORD.finditer(text):
        if MARK.search(word[0]):
            if found and before < found[-1][1]:
                found[-1] = (found[-1][0], word.end())
            else:
                found.append((before, word.end()))
            inside = True
        elif inside:
            found[-1] = (found[-1][0], word.end())
            inside = False
        before = word.start()
    return found


@dataclass
class Field:
    """Weights: for each kind over hashed features, and for an entity right after one, and plain text after one."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(KINDS))))
    moves: np.ndarray = field(default_factory=lambda: np.zeros(2))


def shape_of(span: str) -> str:
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", re.sub(r"[^\W\d_]+", "a", span))
    return re.sub(r"\s+", " ", shape)


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a whole candidate span and of what stands next to it."""
    span = text[start:end]
    digits = _digits(span)
    parts = re.split(r"[\s\[({]*\.[\s\])}]*", span)
    shape = shape_of(span)
    names = [
        "any", f"shape {shape}", f"form {re.sub('9[1-5]', '9', shape)}",
        f"digits {min(len(digits), 20)}", f"at {span.count('@')}",
        f"address {bool(ADDRESS.fullmatch(span))}", f"dots {min(span.count('.'), 5)}",
        f"first {shape_of(span[0])}", f"last {shape_of(span[-1])}",
        f"letters {any(c.isalpha() for c in span)}", f"blanks {min(sum(c.isspace() for c in span), 5)}",
        f"signs {''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))[:8]}",
        f"card {14 <= len(digits) <= 19 and luhn(digits)}",
        f"quad {len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"left {shape_of(text[start - 1]) if start else 'none'}",
        f"right {shape_of(text[end]) if end < len(text) else 'none'}",
    ]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def candidates(text: str, units: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Segments (unit numbers, end exclusive) that hold a mark, and their features."""
    signal = [bool(SIGNAL.search(text, a, b) or a and AT.match(text, a - 1, b + 1)) for a, b in units]
    found, rows = [], []
    for i in range(len(units)):
        has = False
        for j in range(i, min(i + LONGEST, len(units))):
            if units[j][1] - units[i][0] > REACH:
                break
            has = has or signal[j]
            if has:
                found.append((i, j + 1))
                rows.append(span_features(text, units[i][0], units[j][1]))
    return found, np.array(rows, np.int64) if rows else np.zeros((0, 1), np.int64)


def _lattice(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Scores as ``(start, length - 1, kind)``; minus infinity where there is no candidate."""
    grid = np.full((n, LONGEST, len(KINDS)), -np.inf)
    if segments:
        i, j = np.array(segments).T
        grid[i, j - i - 1] = scores
    return grid


def _lse(x: np.ndarray) -> float:
    top = x.max() if x.size else -np.inf
    return float(top + np.log(np.exp(x - top).sum())) if np.isfinite(top) else -np.inf


def marginals(grid: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each segment, expected use of the two moves, and the log of the normalising sum."""
    n = len(grid)
    plain, entity, starts = np.full(n + 2, -np.inf), np.full(n + 2, -np.inf), np.full(n + 1, -np.inf)
    plain[n] = entity[n] = 0.0  # log-weight of all that can follow, by what stands before
    for i in range(n - 1, -1, -1):
        reach = min(LONGEST, n - i)
        starts[i] = _lse((grid[i, :reach] + entity[i + 1 : i + 1 + reach, None]).ravel())
        plain[i] = np.logaddexp(plain[i + 1], starts[i])
        entity[i] = np.logaddexp(moves[1] + plain[i + 1], moves[0] + starts[i])
    after_plain, after_entity = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    after_plain[0] = 0.0
    for j in range(1, n + 1):
        i = np.arange(max(0, j - LONGEST), j)
        into = np.logaddexp(after_plain[i], after_entity[i] + moves[0])
        after_entity[j] = _lse((grid[i, j - i - 1] + into[:, None]).ravel())
        after_plain[j] = np.logaddexp(after_plain[j - 1], after_entity[j - 1] + moves[1])
    into = np.logaddexp(after_plain, after_entity + moves[0])[:n, None, None]
    end = np.minimum(np.arange(n)[:, None] + np.arange(1, LONGEST + 1), n + 1)
    chance = np.exp(into + grid + entity[end][:, :, None] - plain[0])
    used = np.array([np.exp(after_entity[:n] + moves[0] + starts[:n] - plain[0]).sum(),
                     np.exp(after_entity[:n] + moves[1] + plain[1 : n + 1] - plain[0]).sum()])
    return chance, used, plain[0]


def best_segments(grid: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """The most likely segmentation: its entities as (first unit, unit after the last, kind)."""
    n = len(grid)
    plain, entity = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    plain[0] = 0.0
    came: list = [None] * (n + 1)
    for j in range(1, n + 1):
        i = np.arange(max(0, j - LONGEST), j)
        into = np.maximum(plain[i], entity[i] + moves[0])
        total = grid[i, j - i - 1] + into[:, None]
        k, kind = np.unravel_index(total.argmax(), total.shape)
        entity[j], came[j] = total[k, kind], (int(i[k]), int(kind))
        plain[j] = max(plain[j - 1], entity[j - 1] + moves[1])
    found, j, in_entity = [], n, entity[n] > plain[n]
    while j > 0:
        if in_entity:
            i, kind = came[j]
            found.append((i, j, kind))
            in_entity = entity[i] + moves[0] > plain[i]
            j = i
        else:
            in_entity = entity[j - 1] + moves[1] > plain[j - 1]
            j -= 1
    return found[::-1]


def disguises(entity: str, kind: int) -> list[str]:
    """Other ways of writing an entity, none of which the patterns match."""
    digits = _digits(entity)
    if kind == 0:
        return [entity.replace("@", " @ "), entity.replace("@", "(at)"), entity.replace("@", " [at] ")]
    if kind == 1:
        return [entity.replace(".", " . "), entity.replace(".", "[.]")]
    if kind == 2:
        return [" ".join(f"{digits[k:k + 4]}." for k in range(0, len(digits), 4))[:-1],
                "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}",
            f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"]


def examples(text: str) -> list[tuple[str, list[Span]]]:
    """Islands of a text with their entities, each also with its first entity disguised, and with one that is no more one."""
    spans, found = base_spans(text), []
    for a, b in islands(text):
        inside, last = [], 0
        for s, e, kind in spans:
            if s >= a and e <= b and s >= last:
                inside.append((s - a, e - a, kind))
                last = e
        island = text[a:b]
        found.append((island, inside))
        if inside:
            s, e, kind = inside[0]
            ways = disguises(island[s:e], kind)
            other = ways[zlib.crc32(island.encode("utf-8", "surrogatepass")) % len(ways)]
            grown = len(other) - (e - s)
            moved = [(s, s + len(other), kind)] + [(x + grown, y + grown, z) for x, y, z in inside[1:]]
            found.append((island[:s] + other + island[e:], moved))
            if kind == 0:  # without dots there is no host
                found.append((island[:s] + other.replace(".", " ") + island[e:], moved[1:]))
    return found


def train(islands_with_spans: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> Field:
    """Weights by stochastic gradient on log-likelihood; islands with an entity that is no candidate are left out."""
    model, data = Field(), []
    for text, spans in islands_with_spans:
        units = [m.span() for m in UNIT.finditer(text)]
        first, last = {a: k for k, (a, _) in enumerate(units)}, {b: k + 1 for k, (_, b) in enumerate(units)}
        gold = [(first.get(s), last.get(e), kind) for s, e, kind in spans]
        if any(i is None or j is None or j - i > LONGEST for i, j, _ in gold) or not 0 < len(units) <= TRAIN_UNITS:
            continue
        segments, rows = candidates(text, units)
        if {(i, j) for i, j, _ in gold} <= set(segments):
            data.append((len(units), segments, rows, gold))
    seen, seen_moves = np.full_like(model.weights, 0.1), np.full(2, 0.1)
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for k in rng.permutation(len(data)):
            n, segments, rows, gold = data[k]
            chance, used, _ = marginals(_lattice(n, segments, model.weights[rows].sum(axis=1)), model.moves)
            number = {s: i for i, s in enumerate(segments)}
            i, j = np.array(segments, np.int64).reshape(-1, 2).T
            push = -chance[i, j - i - 1]
            for a, b, kind in gold:
                push[number[a, b], kind] += 1
            grad = np.zeros((FEATURES, len(KINDS)))
            touched = np.unique(rows)
            np.add.at(grad, rows.ravel(), np.repeat(push, rows.shape[1], axis=0))
            grad[touched] -= 1e-3 * model.weights[touched]
            seen[touched] += grad[touched] ** 2
            model.weights[touched] += 0.3 * grad[touched] / np.sqrt(seen[touched])
            right = np.zeros(2)
            for (_, b, _), nxt in zip(gold, (gold + [None])[1:], strict=True):
                if b < n:
                    right[0 if nxt and nxt[0] == b else 1] += 1
            seen_moves += (right - used) ** 2
            model.moves += 0.3 * (right - used) / np.sqrt(seen_moves)
    return model


def added_spans(text: str, model: Field, base: list[Span]) -> list[Span]:
    """Entities of the field that overlap no base span."""
    found: list[Span] = []
    for a, b in islands(text):
        units = [m.span() for m in UNIT.finditer(text, a, b)]
        step = WINDOW - 2 * LONGEST
        for k in range(0, len(units), step):  # a very long island in overlapping windows
            low = max(k - LONGEST, 0)
            part = units[low : k + step + LONGEST]
            segments, rows = candidates(text, part)
            if not segments:
                continue
            grid = _lattice(len(part), segments, model.weights[rows].sum(axis=1))
            for i, j, kind in best_segments(grid, model.moves):
                if k <= low + i < k + step:
                    found.append((part[i][0], part[j - 1][1], kind))
    kept: list[Span] = []
    for s, e, kind in sorted(found):
        if (not kept or s >= kept[-1][1]) and not any(s < y and x < e for x, y, _ in base):
            kept.append((s, e, kind))
    return kept


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def fit(docs: DataFrame, documents: int = TRAIN_DOCS, most: int = TRAIN_ISLANDS) -> Field:
    """A field from at most ``documents`` documents with a digit or ``@``, chosen by a hash of their text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(t, s) for x in part.column(0) for t, s in examples(x.as_py()) if len(t) <= TRAIN_LENGTH]
            flat = [[v for span in s for v in span] for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in rows], pa.string()), pa.array(flat, pa.list_(pa.int64()))], ["island", "spans"])

    source = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # ids of texts first, so that ordering moves no text; at most `documents` of them
    chosen = source.select(F.xxhash64("text").alias("chosen")).distinct().orderBy("chosen").limit(documents)
    sample = source.join(F.broadcast(chosen), F.xxhash64("text") == F.col("chosen")).select("text")
    found = sample.mapInArrow(batches, "island string, spans array<long>").distinct()
    rows = found.orderBy(F.xxhash64("island"), "island", "spans").limit(most).collect()
    return train([(r.island, [tuple(r.spans[k : k + 3]) for k in range(0, len(r.spans), 3)]) for r in rows])


def personal_data(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per row of ``docs``.

    Counts and digest are of the base spans, ``spans`` has the added ones too; each as ``kind:start:end``
    in code points, by start. A null text counts as empty. Other columns are ignored.
    """
    model = model or fit(docs)
    shared = sent(docs.sparkSession, model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        for part in parts:
            counts, digests, spans = [], [], []
            for x in part.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, known, base) if MARK.search(text) else []
                counts.append([sum(k == kind for _, _, k in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))),
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        batches, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
