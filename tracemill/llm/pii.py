"""Personal data by weak supervision.

Three labelers vote on every candidate span: a format labeler (regex, checksum, shape), a gazetteer
labeler (key names, issuers, titles, given names) and a context labeler (cue words before the span).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors are the soft labels of a logistic span classifier, which decides over every span that the
fixed patterns of the contract don't already settle.

Each kind that the method adds has three labelers that can say yes and no: shape (mixed characters,
issuable groups, full names), gazetteer (key names and issuers, issued areas, area codes, given names of the
corpus's four languages) and context. How reliable each is by kind is returned in the model.

The text is read once. A task finds the candidates of its documents with their votes and features;
what leaves the executors for training is a table of pattern counts, bounded by the number of
patterns and not by the corpus. The classifier is applied as a column expression.

Defined cases: null text reads as empty, which has no spans; repeated rows, with or without an id, give
repeated results; of spans that start alike the one of the earlier kind stands first, and of added ones that
overlap the first stays; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, store, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, in the order in which they follow the base kinds.
ADDED_KINDS = ("secret", "id_number", "local_phone", "name")
KINDS = BASE_KINDS + ADDED_KINDS

# The patterns of the contract. A run of local characters is entered at its start only,
# or where the last match ended, which finds the same leftmost matches without trying every suffix.
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_RUN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@{_DOMAIN}")
_EMAIL_HERE = re.compile(rf"[A-Za-z0-9._%+-]+@{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9][0-9 .-]{4,}")

# What the method looks for beyond the base patterns.
_KEY_NAMES = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "apikey", "access_key")
_ISSUER_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza")
_TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Herr", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "Sr", "Sra", "Srta", "Señor", "Señora", "Don", "Doña", "Dra",
)
_GIVEN_NAMES = frozenset(
    """Adam Alice Amy Andrew Anna Anne Anthony Barbara Ben Brian Carol Charles Chris Daniel David Deborah Diana Donald Edward Elizabeth Emily Emma Eric Frank George Grace Henry Jack James Jane Jason
    Jennifer Jessica John Joseph Karen Kate Kevin Laura Linda Lisa Margaret Mark Mary Matthew Michael Nancy Oliver Olivia Patricia Paul Peter Richard Robert Ruth Sarah Simon Sophie Steven Susan Thomas William
    Andreas Birgit Christian Claudia Dieter Franziska Friedrich Fritz Gabriele Hans Heike Heinrich Helga Ingrid Jürgen Karl Klaus Lena Lukas Manfred Martin Monika Sabine Stefan Ursula Uwe Wolfgang
    Alain Amélie Antoine Camille Catherine Céline Claire François Françoise Guillaume Hélène Isabelle Jacques Jean Julien Louis Luc Marc Marie Mathieu Michel Nathalie Nicolas Philippe Pierre René Sylvie Yves
    Alejandro Ana Antonio Beatriz Carlos Carmen Diego Elena Fernando Francisco Isabel Javier Jorge José Juan Lucía Luis Manuel María Marta Miguel Pablo Pedro Rafael Rosa Sofía Teresa""".split()
)
#: Area codes of the most populous regions of the North American plan, and the area numbers never issued to persons.
_AREA_CODES = frozenset(
    """201 202 203 206 210 212 213 214 215 216 281 301 303 305 310 312 313 314 315 317 323 330 352 360 401 402 404 405 407 408 410 412 414 415 416 419 425 469 502 503 504 510 512 513 514 516 518 520 530
    540 561 571 585 602 604 609 610 612 614 615 617 619 626 630 631 646 647 650 661 678 702 703 704 707 713 714 716 718 719 720 727 732 757 760 770 773 775 781 786 801 803 804 805 808 813 815 816 817
    818 832 847 858 860 901 903 904 905 908 909 910 913 914 915 916 917 918 919 925 949 951 954 972 973""".split()
)
_UNISSUED = (range(734, 750), range(773, 1000))
_CUES = {
    "secret": ("password", "token", "secret", "key", "credential", "login"),
    "id_number": ("ssn", "social security", "id", "passport", "tax"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile"),
    "name": ("contact", "author", "written by", "from", "dear", "name"),
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
}
_SECRET = re.compile(
    r"(?<![^\W_])(?ai:" + "|".join(_KEY_NAMES) + r")\b[\x20\"']{0,2}[=:][\x20\"']{0,2}(?P<value>[^\s\"',;]{6,})"
    r"|\b(?P<issued>(?:" + "|".join(_ISSUER_PREFIXES) + r")[A-Za-z0-9_-]{12,})"
)
_ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")


def _letters(of) -> str:
    return "".join(c for c in map(chr, range(0x1E960)) if c.isalpha() and of(c))


# Capitals and other letters of any script, with accents that follow them as marks of their own.
_MARKS = r"[\u0300-\u036F]*"
_ONE_NAME = f"[{_letters(lambda c: c.isupper() or c.istitle())}]{_MARKS}(?:[{_letters(lambda c: not c.isupper() and not c.istitle())}]{_MARKS})+"
_NAME = re.compile(r"\b(?:" + "|".join(_TITLES) + rf")\.?\x20(?P<name>{_ONE_NAME}(?:\x20{_ONE_NAME})?)(?!\w)")

ABSTAIN, NO, YES = 0, 1, 2
LABELERS = ("format", "gazetteer", "context")
FEATURES = ("digit", "upper", "lower", "symbol", "long", "mixed", "inline")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        m = (at and _EMAIL_HERE.match(text, at)) or _EMAIL_RUN.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(s: str) -> bool:
    return 10 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's patterns, by start and then kind."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT_RUN.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
        found += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and _is_card(m[0])]
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def added_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidate spans outside the base ones, which the classifier decides over."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEY_NAMES) or any(p in text for p in _ISSUER_PREFIXES):
        found += [(*m.span(m.lastgroup), "secret") for m in _SECRET.finditer(text)]
    if _DIGIT_RUN.search(text):
        found += [(*m.span(), "id_number") for m in _ID_NUMBER.finditer(text)]
        found += [(*m.span(), "local_phone") for m in _LOCAL_PHONE.finditer(text)]
    found += [(*m.span("name"), "name") for m in _NAME.finditer(text)]
    taken, kept = sorted(base), []
    k = 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and y > a for x, y, _ in taken[max(0, k - 1) : k + 2]) and (not kept or kept[-1][1] <= a):
            kept.append((a, b, kind))
    return kept


def _votes(text: str, start: int, end: int, kind: str) -> tuple[int, int, int]:
    s = text[start:end]
    before = text[max(0, start - 32) : start].lower()
    if kind == "secret":
        kinds = sum((any(map(str.isdigit, s)), any(map(str.isupper, s)), any(map(str.islower, s))))
        shape = YES if kinds >= 2 and len(set(s)) >= 6 else NO
        gazetteer = YES if s.startswith(_ISSUER_PREFIXES) or before.rstrip(" \"'=:").endswith(_KEY_NAMES) else ABSTAIN
    elif kind == "id_number":
        area, group, serial = s.split("-")
        shape = NO if "00" in (area[:2] + group, group) or serial == "0000" or area in ("000", "666") else YES
        gazetteer = NO if any(int(area) in r for r in _UNISSUED) else YES
    elif kind == "local_phone":
        digits = "".join(filter(str.isdigit, s))
        shape = NO if digits[0] in "01" or digits[3] in "01" or digits[3:6] == "555" else YES
        gazetteer = YES if digits[:3] in _AREA_CODES else NO if digits[1:3] == "11" else ABSTAIN
    elif kind == "name":
        first, *rest = s.split(" ")
        shape = NO if len(first) < 3 or rest == [first] else YES if rest else ABSTAIN
        gazetteer = YES if first in _GIVEN_NAMES else ABSTAIN
    else:
        shape, gazetteer = YES, ABSTAIN
    return shape, gazetteer, YES if any(c in before for c in _CUES[kind]) else ABSTAIN


def _features(text: str, start: int, end: int) -> int:
    s = text[start:end]
    digit, upper, lower = (any(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    bits = (digit, upper, lower, not s.isalnum(), len(s) >= 16, digit and (upper or lower), start > 0 and text[start - 1] not in "\n")
    return sum(bool(b) << k for k, b in enumerate(bits))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in _FOUND_FIELDS}
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            extra = added_candidates(text, base)
            counts = [0] * len(BASE_KINDS)
            for s in base:
                counts[BASE_KINDS.index(s[2])] += 1
            spans = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
            votes = [_votes(text, *s) for s in spans]
            out["counts"].append(counts)
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
            out["kind"].append([KINDS.index(k) for _, _, k in spans])
            out["start"].append([a for a, _, _ in spans])
            out["stop"].append([b for _, b, _ in spans])
            out["votes"].append([a + 3 * b + 9 * c for a, b, c in votes])
            out["features"].append([_features(text, a, b) for a, b, _ in spans])
        columns = [batch.column("doc_id"), batch.column("text"), *(pa.array(v, _FOUND_FIELDS[k]) for k, v in out.items())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *out])


def _find_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _find(batches):
        yield batch.drop_columns(["text"])


_INTS = pa.list_(pa.int32())
_FOUND_FIELDS = {"counts": _INTS, "base_sha256": pa.string(), "kind": _INTS, "start": _INTS, "stop": _INTS, "votes": _INTS, "features": _INTS}
_FOUND_SCHEMA = "counts array<int>, base_sha256 string, kind array<int>, start array<int>, stop array<int>, votes array<int>, features array<int>"


@dataclass(frozen=True)
class SpanModel:
    """Labeler reliabilities by kind, and the weights of the final classifier."""

    reliability: dict[str, dict[str, float]]
    bias: float
    kind_weights: tuple[float, ...]
    vote_weights: tuple[tuple[float, float, float], ...]
    feature_weights: tuple[float, ...]

    def probability(self, kind: Column, votes: Column, features: Column) -> Column:
        z = F.lit(self.bias) + F.element_at(F.array(*map(F.lit, self.kind_weights)), kind + 1)
        for k, weights in enumerate(self.vote_weights):
            vote = F.floor(votes / 3**k).cast("int") % 3
            z = z + F.element_at(F.array(*map(F.lit, weights)), vote + 1)
        for k, weight in enumerate(self.feature_weights):
            z = z + F.getbit(features, F.lit(k)) * F.lit(weight)
        return 1 / (1 + F.exp(-z))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, P(vote | class) by labeler, and the prior, from pattern counts alone."""
    n_labelers = patterns.shape[1]
    theta = np.empty((n_labelers, 2, 3))
    theta[:, 0], theta[:, 1] = (0.5, 0.4, 0.1), (0.3, 0.1, 0.6)
    prior, posterior = 0.5, np.full(len(counts), 0.5)
    for _ in range(rounds):
        log = np.log([[1 - prior], [prior]]) + np.zeros((2, len(counts)))
        for j in range(n_labelers):
            log += np.log(theta[j][:, patterns[:, j]])
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        for j in range(n_labelers):
            for c in (0, 1):
                seen = np.bincount(patterns[:, j], weights=weight[c], minlength=3) + (theta[j, c] * 2 + 0.1)
                theta[j, c] = seen / seen.sum()
    return posterior, theta, prior


def train(found: DataFrame, steps: int = 400, rate: float = 0.5) -> SpanModel:
    """EM and the span classifier over the table of (kind, votes, features) counts.

    That table has at most ``len(KINDS) * 27 * 128`` rows whatever the corpus, so it may go to the driver.
    """
    spans = found.select(F.explode(F.arrays_zip("kind", "votes", "features")).alias("s")).groupBy("s.kind", "s.votes", "s.features").count()
    rows = spans.orderBy("kind", "votes", "features").collect()
    kind, votes, features, counts = (np.array([r[k] for r in rows], dtype=np.int64).reshape(-1) for k in ("kind", "votes", "features", "count"))
    patterns = np.stack([votes // 3**k % 3 for k in range(len(LABELERS))], axis=1) if len(rows) else np.zeros((0, len(LABELERS)), np.int64)
    soft, reliability = np.zeros(len(rows)), {}
    for k, name in enumerate(KINDS):
        mine = kind == k
        if mine.any():
            soft[mine], theta, _ = expectation_maximisation(patterns[mine], counts[mine].astype(float))
            reliability[name] = {lab: float(theta[j, 1, YES] / max(theta[j, :, YES].sum(), 1e-9)) for j, lab in enumerate(LABELERS)}
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[patterns[:, j]] for j in range(len(LABELERS))), np.stack([features >> b & 1 for b in range(len(FEATURES))], axis=1).astype(float)], axis=1) if len(rows) else np.zeros((0, len(KINDS) + 3 * len(LABELERS) + len(FEATURES)))
    weight, w, bias = np.sqrt(counts) / max(np.sqrt(counts).sum(), 1), np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        gap = weight * (1 / (1 + np.exp(-(x @ w + bias))) - soft)
        w -= rate * (x.T @ gap * 4 + 1e-4 * w)
        bias -= rate * gap.sum() * 4
    n = len(KINDS)
    by_vote = tuple(tuple(map(float, w[n + 3 * j : n + 3 * j + 3])) for j in range(len(LABELERS)))
    return SpanModel(reliability, float(bias), tuple(map(float, w[:n])), by_vote, tuple(map(float, w[n + 3 * len(LABELERS) :])))


def find_spans(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document with its base counts and digest, and all candidates with votes and features."""
    slim = docs.select("doc_id", text_of().alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(_find if with_text else _find_only, f"doc_id {kind}, {'text string, ' if with_text else ''}{_FOUND_SCHEMA}")


def detect(docs: DataFrame, threshold: float = 0.5, with_text: bool = False) -> DataFrame:
    """Personal data of every document: base spans, which always stay, and those the classifier adds.

    Returns doc_id, ``found`` (array of kind, start, stop, added; ends exclusive, in code points), the base
    counts and the base digest; ``with_text`` adds the text. The candidates are stored once, with the text
    only if asked for, so the texts are read a single time.
    """
    found = store(find_spans(docs, with_text), "pii")
    model = train(found)
    spans = F.arrays_zip("kind", "start", "stop", "votes", "features")
    n_base = len(BASE_KINDS)
    kept = F.filter(spans, lambda s: (s["kind"] < n_base) | (model.probability(s["kind"], s["votes"], s["features"]) >= threshold))
    names = F.array(*map(F.lit, KINDS))
    shaped = F.transform(kept, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), (s["kind"] >= n_base).alias("added")))
    return found.select("doc_id", "counts", "base_sha256", shaped.alias("found"), *(["text"] if with_text else []))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and text with every found span replaced by its kind in brackets; each row by its own spans."""
    spans = detect(docs, threshold, with_text=True)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        grown = F.concat(acc["done"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, grown).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["stop"]).alias("at"))

    folded = spans.select("doc_id", F.aggregate("found", start, step).alias("acc"), "text")
    return folded.select("doc_id", F.concat("acc.done", F.expr("substr(text, acc.at + 1)")).alias("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`detect` over all of ``documents``."""
    d = detect(documents(spark, sf_dir))
    counts = [F.element_at("counts", k + 1).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    written = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return d.select("doc_id", *counts, "base_sha256", written.alias("spans"), F.size(F.filter("found", lambda s: s["added"])).cast("long").alias("n_added"))
