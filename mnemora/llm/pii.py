"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns, checks included, and always stay. The field then labels the
candidate tokens (runs of non-space characters with a digit or an @) of every document that has any, whether patterns
found something there or not. Its factors:

* of one token: its shape, and the word before it;
* chain: tokens that follow each other;
* skip: each token and the last one before it in the document that is the same (equal letters and digits once case
  and punctuation are taken away, five at least) or similar: numbers of the same digits however they are grouped
  (whole stretches of digit groups, group by group), numbers of the same last TAIL digits, forms that differ by one
  character, addresses of one host or one network. n alike tokens have n-1 factors.

Loopy belief propagation (sum-product, damped) lets a label found in one place reach the same entity elsewhere.
Tokens under a base span are held at its label; a token under a pattern whose check failed can't be of that kind. An
added span is a maximal run of tokens whose likeliest label is one kind, one of them with a probability of SURE,
without punctuation at its ends, that touches no base span.

The factors are trained piecewise, each as the log of its own smoothed conditional counts, with base spans as labels,
over all documents: the statistics are tables of fixed size (shapes and words hashed to CELLS rows), counted where the
texts are and summed. A type of pair that no two base spans are of keeps the prior AGREE and the labels' shares.

What is linked or added has these limits: the word before a token is looked for within 24 characters; digit groups are
joined to numbers of MOST_DIGITS digits, the longest of any kind; forms of EDIT to MOST_EDITED characters are compared up to one
character; an added span holds what any of its kind does (`enough`: an @; three dots and four digits; 13 to 19 digits; 7 to 15).

Defined cases: a null or empty text has no spans; very long texts are read whole, in time linear in their
tokens; repeated rows have equal spans; a null id is kept; an empty table trains a field that adds nothing to a text
without a base span."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("",) + KINDS
#: Fixed patterns of the base kinds; an email's local part is taken leftwards from its @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\s0-9@]*[0-9@]\S*")
_EDGE = "()[]{}<>.,;:!?\"'`*#$%&|/\\"
#: What may stand between the groups of one number.
_GAP = re.compile(r"[\x20().-]{1,3}")
#: The word before a token.
_CUE = re.compile(r"([^\W\d_]+)[^\w\n]{1,4}$")
ROUNDS, DAMP, LEAST_FORM = 30, 0.3, 5
MOST_DIGITS = 19
#: Rows of each hashed table, factors of pairs by type, and how strongly alike tokens agree before anything is counted.
CELLS, FACTORS, AGREE = 1 << 13, ("chain", "same", "digits", "tail", "edit", "part"), 10.0
#: Last digits that tell two numbers alike; lengths of forms that may differ by one character.
TAIL, EDIT, MOST_EDITED = 7, 8, 64
#: Probability from which a kind is taken.
SURE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))


def good_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping within a kind."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < m.start():
            out.append(("email", a, m.end()))
            end = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if good_ip(m.group())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if good_card(m.group())]
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Candidate tokens, punctuation at their ends taken away."""
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def shape(token: str) -> str:
    """Digits as 9, letters as a, runs of letters shortened to one, runs of digits to four at most."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]+", "a", token))
    return re.sub(r"9{4,}", "9999", s)


def cue(text: str, start: int) -> str:
    """The word that stands before a token with a blank and a little punctuation between, in lower case."""
    m = _CUE.search(text, max(0, start - 24), start)
    return m.group(1).lower() if m else ""


def form(token: str) -> str:
    return re.sub(r"[\W_]+", "", token).lower()


def cells(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The table rows of each token's shape and of the word before it."""
    return [(zlib.crc32(shape(text[a:b]).encode()) % CELLS, CELLS + zlib.crc32(cue(text, a).encode()) % CELLS) for a, b in found]


def refused(text: str, found: list[tuple[int, int]]) -> np.ndarray:
    """[tokens, labels]: kinds whose pattern a token lies under and whose check it fails; it can't be such."""
    out = np.zeros((len(found), len(LABELS)), bool)
    starts = [a for a, _ in found]
    for kind, pattern, good in (("ip", _IP, good_ip), ("card", _CARD, lambda t: not 16 <= sum(c.isdigit() for c in t) <= 19 or good_card(t))):
        for m in pattern.finditer(text):
            if not good(m.group()):
                i = max(0, bisect_right(starts, m.start()) - 1)
                while i < len(found) and found[i][0] < m.end():
                    out[i, LABELS.index(kind)] |= found[i][1] > m.start()
                    i += 1
    return out


def labelled(spans: list[tuple[str, int, int]], found: list[tuple[int, int]]) -> np.ndarray:
    """The kind (0: none) of the base span that each token overlaps; the first kind wins."""
    y = np.zeros(len(found), np.int64)
    starts = [a for a, _ in found]
    for kind, a, b in reversed(spans):
        i = max(0, bisect_right(starts, a) - 1)
        while i < len(found) and found[i][0] < b:
            if found[i][1] > a:
                y[i] = LABELS.index(kind)
            i += 1
    return y


def grouped(text: str, found: list[tuple[int, int]], forms: list[str]) -> list[tuple[int, int]]:
    """Skip pairs between stretches of digit groups of the same digits, one of two groups at least."""
    digits = [f.isascii() and f.isdigit() for f in forms]
    last: dict[str, tuple[int, int]] = {}
    out, start = [], 0
    while start < len(found):
        stop = start + 1
        while stop < len(found) and digits[stop - 1] and digits[stop] and _GAP.fullmatch(text, found[stop - 1][1], found[stop][0]):
            stop += 1
        seen, at = [], start
        for i in range(start, stop if digits[start] else start):
            f, best = "", None
            for j in range(i, stop):
                f += forms[j]
                if len(f) > MOST_DIGITS:
                    break
                if len(f) >= LEAST_FORM:
                    seen.append((f, (i, j)))
                    best = (last[f], j) if f in last else best
            if best and i >= at:
                (a, b), j = best
                if b > a or j > i:
                    out += [(min(a + k, b), min(i + k, j)) for k in range(max(b - a, j - i) + 1)]
                at = j + 1
        last.update(seen)
        start = stop
    return out


def similar_forms(text: str, found: list[tuple[int, int]], forms: list[str]) -> Iterator[tuple[str, int, int]]:
    """(type, i, j): tokens that are alike without being equal, each with the last one before it."""
    last: dict[tuple[str, str], int] = {}
    for i, ((a, b), f) in enumerate(zip(found, forms)):
        keys: list[tuple[str, str]] = []
        number = "".join(c for c in f if c.isdigit())
        if len(number) >= TAIL:
            keys.append(("tail", number[-TAIL:]))
        if EDIT <= len(f) <= MOST_EDITED:
            keys += [("edit", f), *(("edit", f"{f[:k]}{f[k + 1:]}") for k in range(len(f)))]
        token = text[a:b]
        if "@" in token:
            keys.append(("part", token.rpartition("@")[2].lower()))
        elif token.count(".") == 3 and number and form(token) == number:
            keys.append(("part", token.rpartition(".")[0]))
        met = {}
        for k in keys:
            if k in last and forms[last[k]] != f:
                met.setdefault((k[0], last[k]), None)
            last[k] = i
        yield from ((kind, j, i) for kind, j in met)


def edges(text: str, found: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[str, int, int]]]:
    """(chain pairs, skip factors with their types) of token numbers; a pair has one factor at most."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 3 and "\n" not in text[found[i][1] : found[i + 1][0]]]
    forms = [form(text[a:b]) for a, b in found]
    taken, last, skip = set(chain), {}, []

    def add(kind: str, i: int, j: int) -> None:
        if i != j and (i, j) not in taken:
            taken.add((i, j))
            skip.append((kind, i, j))

    for i, f in enumerate(forms):
        if len(f) >= LEAST_FORM:
            if f in last:
                add("same", last[f], i)
            last[f] = i
    for i, j in grouped(text, found, forms):
        add("digits", i, j)
    for kind, i, j in similar_forms(text, found, forms):
        add(kind, i, j)
    return chain, skip


def statistics(texts: Iterable[str]) -> dict[tuple[int, int], int]:
    """(row, cell) -> count over texts, of what the factors are made from. Rows below 2 * CELLS: how often a shape or
    a word before has each label. Then one row of label pairs for chain factors and one for each type of
    skip factor. Labels are those of base spans; a token without one that a skip factor joins with one is what
    the patterns miss, its label is unknown and it isn't counted."""
    out: Counter = Counter()
    k = len(LABELS)
    for t in texts:
        found = tokens(t)
        if not found:
            continue
        y = labelled(base_spans(t), found).tolist()
        near, far = edges(t, found)
        unknown = {i if y[j] else j for _, i, j in far if (y[i] > 0) != (y[j] > 0)}
        for i, (a, b) in enumerate(cells(t, found)):
            if i not in unknown:
                out[a, y[i]] += 1
                out[b, y[i]] += 1
        for kind, i, j in [("chain", i, j) for i, j in near] + far:
            if i not in unknown and j not in unknown:
                out[2 * CELLS + FACTORS.index(kind), y[i] * k + y[j]] += 1
    return out


class Field:
    """Log potentials: of shapes and of words before [CELLS, labels] each, and of pairs [labels, labels] per type."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        k = len(LABELS)
        seen, pairs = np.zeros((2 * CELLS, k)), np.zeros((len(FACTORS), k, k))
        for (row, cell), n in counts.items():
            if row < 2 * CELLS:
                seen[row, cell] += n
            else:
                pairs[row - 2 * CELLS, cell // k, cell % k] += n
        prior = seen[:CELLS].sum(axis=0) + 1
        prior /= prior.sum()
        given = np.log((seen + 2 * prior) / (seen.sum(axis=1, keepdims=True) + 2))
        self.shape = given[:CELLS]
        self.cue = np.clip(given[CELLS:] - np.log(prior), -1, 1)
        self.pair = np.zeros((len(FACTORS), k, k))
        for f, n in enumerate(pairs):
            if f:  # skip factors have no direction, and agreement is what they are for
                n = n + n.T + np.outer(prior, prior) + np.diag(prior) * AGREE
            both = (n + np.outer(prior, prior)) / (n.sum() + 1)
            self.pair[f] = np.clip(np.log(both / np.outer(both.sum(axis=1), both.sum(axis=0))), -2 if not f else -3, 2 if not f else 3)

    def marginals(self, unary: np.ndarray, pairs: list[tuple[int, int]], weight: list[np.ndarray]) -> np.ndarray:
        """Log marginals by loopy sum-product in the log domain over directed copies of the pairs, until messages
        rest or ROUNDS are over; exact where the pairs make no loop of at most ROUNDS steps across."""
        if pairs:
            a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
            b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
            w = np.stack(weight + [x.T for x in weight])
            back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
            message = np.zeros((len(a), unary.shape[1]))
            belief = unary.copy()
            for _ in range(ROUNDS):
                out = belief[a] - message[back]
                new = out[:, :, None] + w
                top = new.max(axis=1, keepdims=True)
                new = top[:, 0] + np.log(np.exp(new - top).sum(axis=1))
                new = DAMP * message + (1 - DAMP) * (new - new.max(axis=1, keepdims=True))
                moved, message = np.abs(new - message).max(), new
                belief = unary.copy()
                np.add.at(belief, b, message)
                if moved < 1e-6:
                    break
        else:
            belief = unary
        top = belief.max(axis=1, keepdims=True)
        return belief - top - np.log(np.exp(belief - top).sum(axis=1, keepdims=True))

    def unary(self, text: str, found: list[tuple[int, int]], y: np.ndarray) -> np.ndarray:
        """Log potentials of each token; tokens under a base span are held at its label, refused kinds left out."""
        at = np.array(cells(text, found))
        out = self.shape[at[:, 0]] + self.cue[at[:, 1] - CELLS]
        out[refused(text, found)] = -30.0
        out[y > 0] = -30.0
        out[y > 0, y[y > 0]] = 0.0
        return out

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Runs of tokens whose likeliest label is one kind, one of them with a probability of SURE, that hold enough
        of it."""
        found = tokens(text)
        if not found:
            return []
        y = labelled(base, found)
        unary = self.unary(text, found, y)
        near, far = edges(text, found)
        weight = [self.pair[0]] * len(near) + [self.pair[FACTORS.index(f)] for f, _, _ in far]
        p = self.marginals(unary, near + [(i, j) for _, i, j in far], weight)
        best, sure = p.argmax(axis=1).tolist(), (p.max(axis=1) >= np.log(SURE)).tolist()
        follows, run = set(near), []
        for i, (a, b) in enumerate(found):
            if y[i] or not best[i]:
                continue
            if run and run[-1][0] == best[i] and (i - 1, i) in follows and run[-1][2] == found[i - 1][1]:
                run[-1] = (best[i], run[-1][1], b, run[-1][3] or sure[i])
            else:
                run.append((best[i], a, b, sure[i]))
        return [(LABELS[k], a, b) for k, a, b, certain in run if certain and enough(LABELS[k], text[a:b])]


def enough(kind: str, found: str) -> bool:
    """What any span of a kind has to hold."""
    digits = sum(c.isdigit() for c in found)
    return {"email": "@" in found, "ip": found.count(".") >= 3 and digits >= 4, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def learn(docs: DataFrame) -> Field:
    """A field of the statistics of all texts of docs. Every task counts its own; the driver gathers at most
    2 * CELLS * labels + types * labels**2 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(statistics(b.column(0).to_pylist()))
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in rows], pa.int32()), pa.array([x[0][1] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64())], names=["row", "cell", "n"])

    texts = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    counts = texts.mapInArrow(run, "row int, cell int, n long").groupBy("row", "cell").agg(F.sum("n").alias("n")).collect()
    return Field({(r["row"], r["cell"]): r["n"] for r in counts})


def find(docs: DataFrame, field: Field) -> DataFrame:
    """docs with base and added: arrays of (kind, start, end) in code points; columns of these names that
    docs may have are replaced."""
    docs = docs.drop("base", "added")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            base, more = [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t) if t else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                more.append([{"kind": k, "start": s, "end": e} for k, s, e in (f.added(t, spans) if t else [])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, kind), pa.array(more, kind)], names=[*b.schema.names, "base", "added"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(run, f"{schema}, base {spans}, added {spans}")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of text replaced by <KIND>; overlapping spans are joined under the first."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(text: str | None, f: Field) -> str | None:
        base = base_spans(text) if text else []
        spans = sorted((a, -b, k) for k, a, b in base + f.added(text, base)) if text else []
        if not spans:
            return text
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"<{k.upper()}>"]
            at = max(at, -b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t, f) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
