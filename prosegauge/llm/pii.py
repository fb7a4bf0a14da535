"""Personal data by weak supervision.

Base spans come from four fixed patterns. Beside them, wider patterns propose candidates: cards and
phone numbers that a base pattern swallowed in a longer run of digits, spelled-out addresses, and
secrets. On each candidate the labelers vote for, against or not at all: the base pattern, a
gazetteer (issuer prefixes, country codes, domain endings, key names), cue words before it, its
grouping, and a check of its content. The votes of all documents are counted by pattern, and every
pattern counts; expectation-maximisation over the counts by votes estimates how reliable each labeler
is for each kind, without labels. Its posteriors train the final span classifier, a logistic model over the form of a
candidate and its neighbours. Candidates that it accepts are added where no base span lies.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_kept, stored

#: Kinds in the order of the results; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "gazetteer", "context", "grouping", "content")

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Whole runs of numbers and dots; matches of _IP are each four numbers of a run, from its start.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of further candidates.
_WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z(+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_.-]{8,})"),
}
_AT = re.compile(r" ?[\[(] ?at ?[\])] ?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++")
#: Characters without which a pattern of a kind cannot match.
_NEEDS = {"ip": (".",), "card": (), "phone": ("-", ".", " "), "secret": ("=", ":")}
_DIGIT = re.compile(r"[0-9]")

_CUES = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mailto|reply|courriel|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|from|login|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|dial|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|password|passwd|pwd|key|auth|credential)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:isbn|issn|order|invoice|version|page|serial|item|ref|no)\b\.?:? *$", re.I)
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co us".split())
_COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 52 55 61 64 65 81 82 86 90 91 351 353 358".split())
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
CONTEXT_CHARS = 30


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _quads(text: str) -> Iterator[tuple[int, list[str]]]:
    """(start, the four numbers) of each match of _IP, in time linear in the text."""
    if "." not in text:
        return
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            yield at, parts[k : k + 4]
            at += sum(map(len, parts[k : k + 4])) + 4


def _spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses like ``name (at) host (dot) org``: from the bracket, back over the local part."""
    last = 0
    for m in _AT.finditer(text):
        at = m.start()
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _SPELLED_DOMAIN.match(text, m.end())):
            last = domain.end()
            yield start, last


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    found: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:  # a match holds the whole run of local characters before its @
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return found
    for a, parts in _quads(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            found.append(("ip", a, a + sum(map(len, parts)) + 3))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    form: tuple[str, ...] = field(default=())


def _near(text: str, at: int, step: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else "quote" if c in "\"'" else "mark"


def describe(text: str, kind: str, start: int, end: int, base: bool) -> Candidate:
    """The votes of the labelers (1, -1 or 0) and the form of a candidate."""
    span, before = text[start:end], text[max(0, start - CONTEXT_CHARS) : start]
    digits = _digits(span)
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]", span)[-1].lower() in _ENDINGS else -1
        grouping = 1 if "@" in span else 0
        content = 1 if len(span) <= 254 and ".." not in span else -1
    elif kind == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        gazetteer = -1 if parts[0] in (0, 255) else 1
        grouping = 1 if len(parts) == 4 and not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
        content = 1 if max(parts) <= 255 else -1
    elif kind == "card":
        gazetteer = 1 if _ISSUER.match(digits) else -1
        grouping = 1 if re.fullmatch(r"[0-9]{16,19}|[0-9]{4}([ -])(?:[0-9]{4}\1){2}[0-9]{4}", span) else -1
        content = 1 if luhn(digits) else -1
    elif kind == "phone":
        code = re.match(r"\+([0-9]+)", span)
        gazetteer = 0 if not code else 1 if any(code[1].startswith(c) for c in _COUNTRY) else -1
        grouping = 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", span) else 0
        content = 1 if 8 <= len(digits) <= 15 else -1
    else:
        gazetteer = 1
        grouping = 1 if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Za-z0-9+/_-]{20,}", span) else -1
        counts = Counter(span)
        bits = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
        content = 1 if bits >= 2.5 and digits and len(digits) < len(span) else -1
    context = -1 if _AGAINST.search(before) else 1 if _CUES[kind].search(before) else 0
    form = (
        f"digits{min(len(digits) // 4, 6)}",
        f"length{min(len(span) // 8, 6)}",
        f"left:{_near(text, start - 1, -1)}",
        f"right:{_near(text, end, 1)}",
        f"head:{'+' if span[0] == '+' else 'digit' if span[0].isdigit() else 'letter' if span[0].isalpha() else 'mark'}",
        f"marks:{''.join(sorted(set(c for c in span if not c.isalnum())))[:4]}",
        f"sound:{grouping + content}",
    )
    return Candidate(kind, start, end, base, (1 if base else 0 if kind in ("secret", "phone") else -1, gazetteer, context, grouping, content), form)


def candidates(text: str) -> list[Candidate]:
    """Base spans and further candidates; of a kind, those that overlap a base span are left out."""
    base = base_spans(text)
    found = [describe(text, k, a, b, True) for k, a, b in base]
    digit = bool(_DIGIT.search(text))
    wide: list[tuple[str, Iterator[tuple[int, int]]]] = []
    if "at" in text and ("[" in text or "(" in text):
        wide.append(("email", _spelled_emails(text)))
    for kind, pattern in _WIDE.items():
        if (kind != "secret" and not digit) or (_NEEDS[kind] and not any(c in text for c in _NEEDS[kind])):
            continue
        wide.append((kind, (m.span(1 if kind == "secret" else 0) for m in pattern.finditer(text))))
    for kind, spans in wide:
        own = [(a, b) for k, a, b in base if k == kind]
        j = 0
        for a, b in spans:
            while j < len(own) and own[j][1] <= a:
                j += 1
            if j == len(own) or own[j][0] >= b:
                found.append(describe(text, kind, a, b, False))
    return found


class _Taken:
    """Stretches of a text that are taken, disjoint and in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take a stretch if all of it is free."""
        k = bisect(self.starts, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.starts) and self.starts[k] < b):
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


@dataclass
class PiiModel:
    """For each kind: the labelers' shares of votes for and against on true and false spans, the
    share of true candidates, and the weights of the span classifier by feature."""

    reliability: dict[str, tuple[np.ndarray, np.ndarray, float]] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def probability(self, c: Candidate) -> float:
        w = self.weights.get(c.kind)
        if w is None:
            return 0.0
        z = w["bias"] + sum(w.get(f, 0.0) for f in c.form)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    def spans(self, text: str, least: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans), each by kind, then start. Added spans overlap no span of a
        base pattern and no other added one; the likelier, then the earlier, wins."""
        found = candidates(text)
        base = [(c.kind, c.start, c.end) for c in found if c.base]
        open_ = sorted(((self.probability(c), -c.start, c) for c in found if not c.base), key=lambda x: (-x[0], -x[1], KINDS.index(x[2].kind)))
        taken = _Taken((a, b) for _, a, b in base)
        added = [
            (c.kind, c.start, c.end) for p, _, c in open_ if p >= least and sum(v > 0 for v in c.votes) >= 2 and taken.add(c.start, c.end)
        ]
        order = {k: n for n, k in enumerate(KINDS)}
        key = lambda s: (order[s[0]], s[1])
        return sorted(base, key=key), sorted(base + added, key=key)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Labeler shares (true / false: labeler x [against, silent, for]), prior, posterior by pattern.

    votes: a row per pattern. Starts from the majority and keeps labelers better than chance by
    counts added to the shares.
    """
    posterior = np.clip(0.5 + 0.4 * np.sign(votes.sum(axis=1)), 0.1, 0.9)
    hot = (votes[:, :, None] == np.array([-1, 0, 1])[None, None, :]).astype(float)
    good, bad = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0])
    prior = 0.5
    shares = []
    for _ in range(rounds):
        before = posterior
        shares = []
        for weight, added in ((posterior * counts, good), ((1 - posterior) * counts, bad)):
            s = np.einsum("n,njk->jk", weight, hot) + added
            shares.append(s / s.sum(axis=1, keepdims=True))
        prior = float((posterior @ counts + 1) / (counts.sum() + 2))
        log = [np.einsum("njk,jk->n", hot, np.log(s)) for s in shares]
        z = np.log(prior / (1 - prior)) + log[0] - log[1]
        posterior = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        if np.abs(posterior - before).max() < 1e-6:
            break
    return shares[0], shares[1], prior, posterior


def parted(pattern: str) -> tuple[tuple[int, ...], list[str]]:
    """(votes, form features) of a pattern, "votes;form features joined by |"."""
    votes, form = pattern.split(";", 1)
    return tuple(map(int, votes.split(","))), form.split("|")


#: Gradient and Hessian, without the penalty, of the loss of each kind at its weights.
Slopes = Callable[[dict[str, np.ndarray]], dict[str, tuple[np.ndarray, np.ndarray]]]


def slopes(rows: list[tuple[str, str, int]], trust: dict[str, dict[tuple, float]], index: dict[str, dict[str, int]], weights: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """What (kind, pattern, count) rows add to the slopes of the kinds in weights.

    trust: the posterior by kind and votes; index: the place of each form feature in the weights.
    """
    out = {}
    for kind, w in weights.items():
        own = [(*parted(p), n) for k, p, n in rows if k == kind]
        if not own:
            continue
        counts = np.array([n for _, _, n in own], dtype=float)
        posterior = np.array([trust[kind][v] for v, _, _ in own])
        at = np.array([[0, *(index[kind][f] for f in form)] for _, form, _ in own])
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -35, 35)))
        bend = counts * np.maximum(p * (1 - p), 1e-6)
        gradient = np.bincount(at.ravel(), np.repeat(counts * (p - posterior), at.shape[1]), len(w))
        pairs = (at[:, :, None] * len(w) + at[:, None, :]).reshape(len(own), -1)
        hessian = np.bincount(pairs.ravel(), np.repeat(bend, pairs.shape[1]), len(w) ** 2).reshape(len(w), -1)
        out[kind] = gradient, hessian
    return out


def fit_by_votes(votes: dict[str, dict[tuple, int]], names: dict[str, list[str]], slopes_at: Callable[[dict, dict], Slopes]) -> PiiModel:
    """The model of the counts by kind and votes, the form features of each kind, and the slopes
    that slopes_at() gives for (trust, index), see slopes()."""
    model, trust = PiiModel(), {}
    index = {kind: {f: k + 1 for k, f in enumerate(names[kind])} for kind in votes}
    for kind in KINDS:
        if kind not in votes:
            continue
        own = sorted(votes[kind])
        good, bad, prior, posterior = expectation_maximisation(np.array(own), np.array([votes[kind][v] for v in own], dtype=float))
        model.reliability[kind] = (good, bad, prior)
        trust[kind] = dict(zip(own, posterior.tolist(), strict=True))
    sums = slopes_at(trust, index)
    weights = {kind: np.zeros(len(index[kind]) + 1) for kind in trust}
    still = dict(weights)
    for _ in range(30):  # Newton steps of the penalised logistic loss on soft labels
        for kind, (gradient, hessian) in sums(still).items():
            w = weights[kind]
            penalty = np.full(len(w), 0.05)
            step = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)
            weights[kind] = w - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
            still[kind] = weights[kind]
            if np.abs(step).max() < 1e-6:
                del still[kind]
        if not still:
            break
    for kind, w in weights.items():
        model.weights[kind] = {"bias": float(w[0])} | {f: float(w[k]) for f, k in index[kind].items()}
    return model


def fit_from_counts(rows: list[tuple[str, str, int]]) -> PiiModel:
    """The model of (kind, pattern, count) rows; pattern is "votes;form features joined by |"."""
    rows = sorted(rows)
    votes: dict[str, Counter] = {}
    names: dict[str, set] = {}
    for kind, pattern, n in rows:
        v, form = parted(pattern)
        votes.setdefault(kind, Counter())[v] += n
        names.setdefault(kind, set()).update(form)
    return fit_by_votes(votes, {k: sorted(f) for k, f in names.items()}, lambda trust, index: lambda w: slopes(rows, trust, index, w))


def fit_from_table(counted: DataFrame) -> PiiModel:
    """fit_from_counts() of a table (kind, pattern, n) of any length: only counts by votes (3^5 a
    kind at most), the names of the features, and sums over pairs of features reach the driver."""
    votes: dict[str, dict] = {}
    for kind, v, n in counted.groupBy("kind", F.split("pattern", ";")[0].alias("v")).agg(F.sum("n")).collect():
        votes.setdefault(kind, {})[parted(f"{v};")[0]] = n
    names: dict[str, list] = {}
    form = F.explode(F.split(F.split("pattern", ";", 2)[1], "\\|"))
    for kind, f in counted.select("kind", form.alias("f")).distinct().collect():
        names.setdefault(kind, []).append(f)

    def slopes_at(trust: dict, index: dict) -> Slopes:
        def sums(weights: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                forget_kept()
                for batch in batches:
                    rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "pattern", "n")), strict=True))
                    for kind, (gradient, hessian) in slopes(rows, trust, index, weights).items():
                        every = np.vstack([gradient, hessian])
                        at = np.flatnonzero(every)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at, pa.int64()), pa.array(every.ravel()[at])], ["kind", "at", "x"])

            found = counted.mapInArrow(run, "kind string, at long, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
            kinds, at, x = (np.array(found.column(c).to_pylist()) for c in ("kind", "at", "x"))
            out = {}
            for kind, w in weights.items():
                every = np.zeros((len(w) + 1) * len(w))
                every[at[kinds == kind]] = x[kinds == kind]
                out[kind] = every[: len(w)], every[len(w) :].reshape(len(w), -1)
            return out

        return sums

    return fit_by_votes(votes, {k: sorted(f) for k, f in names.items()}, slopes_at)


#: Patterns up to which the driver fits the model itself; of more the same sums are taken by tasks.
DRIVER_PATTERNS = 20_000


def fit_pii(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Count vote patterns over all documents and train on all counts."""
    texts = docs.select(F.col(text_col).alias("txt")).where("txt is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("txt"):
                for c in candidates(text.as_py()):
                    seen[c.kind, f"{','.join(map(str, c.votes))};{'|'.join(c.form)}"] += 1
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([p for _, p in keys]), pa.array([seen[k] for k in keys], pa.int64())], ["kind", "pattern", "n"])

    counted = stored(texts.mapInArrow(count, "kind string, pattern string, n long").groupBy("kind", "pattern").agg(F.sum("n").alias("n")), "patterns")
    if counted.count() > DRIVER_PATTERNS:
        return fit_from_table(counted)
    return fit_from_counts([tuple(r) for r in counted.collect()])


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, ``base`` and ``spans``, arrays of (kind, start, end) by kind
    in the order of KINDS, then start; code points, end exclusive.

    A null text is empty and has no spans. Rows with equal ids are kept apart. The time is linear in
    the length of a text, but for an insertion into a list per span. No rows: no rows.
    """
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            base, every = [], []
            for text in batch.column("txt"):
                a, b = model.spans(text.as_py())
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in a])
                every.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, arrow), pa.array(every, arrow)], ["id", "base", "spans"])

    return source.mapInArrow(run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, ``<email>``.

    Texts without spans, and null ones, stay as they are; where spans of two kinds overlap, the
    outer stretch is replaced once by the kind that starts first. Other columns are unchanged.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            texts = [mask(t.as_py(), model) for t in batch.column(text_col)]
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, text_col, pa.array(texts, batch.schema.field(i).type))

    return docs.select(*(f"`{c}`" for c in names)).mapInArrow(run, docs.schema)


def mask(text: str | None, model: PiiModel) -> str | None:
    if not text:
        return text
    out, at = [], 0
    spans = sorted(model.spans(text)[1], key=lambda s: (s[1], -s[2]))
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def written(spans: str) -> F.Column:
    """An array of spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_pii() with a model of the same documents."""
    return find_pii(docs, fit_pii(docs, text_col), id_col, text_col)


