"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Strict patterns (e-mail, IP, payment card, phone) give the base spans, which always stay. Looser
patterns give candidate spans of more kinds. Three families of labelers vote on every span, base
or candidate: patterns on its own characters, gazetteers of words around it, and the context it
stands in. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates
how reliable each labeler is; its posteriors train a logistic classifier on span features, which
accepts or rejects the candidates.

Texts are read once. What is collected are counts by kind, votes and features, whose number is
bounded by their definitions (see ``vote_counts``), not by the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.text import as_str, id_and_text, id_type, slices
from textpulse.session import materialize

BASE = ("email", "ip", "card", "phone")
#: All kinds in the order in which spans are listed.
KINDS = (*BASE, "secret", "ssn", "iban")
LABELERS = ("shape", "charset", "gazetteer", "context", "border")
#: A candidate is accepted from this probability on.
ACCEPT = 0.8

# -- base spans ---------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so a run is tried from its first digit only
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` outwards: the local part is the run of
    its characters before, cut at the last match, so long runs without ``@`` cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each base kind; a match that fails its check is dropped."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE}
    if "@" in text:
        out["email"] = list(find_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# -- candidates, votes and features -------------------------------------------------------------

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63})+", re.IGNORECASE),
    "phone": re.compile(r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=-])"),
}
_WORD = re.compile(r"[A-Za-z]+")
#: Gazetteers of words that stand near each kind.
NEAR = {
    "email": frozenset("email mail e contact write reach at address correo courriel".split()),
    "ip": frozenset("ip host server address from client addr".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte".split()),
    "phone": frozenset("phone tel call mobile fax cell whatsapp telefon telefono".split()),
    "secret": frozenset("token key secret password passwd pwd api apikey bearer auth credential access".split()),
    "ssn": frozenset("ssn social security number".split()),
    "iban": frozenset("iban account bank konto cuenta compte".split()),
}
#: How issued keys begin.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "ya29", "eyJ", "npm_", "hf_")
AROUND = 32


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    moved = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes_on(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 no opinion."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    if kind == "secret":
        shape = 1 if span.startswith(KEY_STARTS) or re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span) else -1 if not digits or span.isdigit() else 0
        entropy = _entropy(span)
        charset = 1 if entropy >= 3.3 and digits else 0 if entropy >= 2.5 and digits else -1
    elif kind == "card":
        shape = 1 if luhn("".join(c for c in span if c.isdigit())) else -1
        charset = 1 if 13 <= digits <= 19 else -1
    elif kind == "iban":
        shape = 1 if _iban_ok(span) else -1
        charset = 1 if digits >= 8 else -1
    elif kind == "ssn":
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
        charset = 0
    elif kind == "phone":
        shape = 1 if span[0] in "+(" else 0
        charset = 1 if 9 <= digits <= 15 else -1
    else:
        shape, charset = 1, 1 if digits or "." in span or "@" in span else 0
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    near = {w.lower() for w in _WORD.findall(before)} | {w.lower() for w in _WORD.findall(after)}
    gazetteer = 1 if near & NEAR[kind] else 0
    context = 1 if re.search(r"[:=#]\s*[\"']?$", before) else 0
    glued = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-_/")) or (b < len(text) and (text[b].isalnum() or text[b] in "-_/"))
    return shape, charset, gazetteer, context, -1 if glued else 0


def features_of(kind: str, text: str, a: int, b: int) -> str:
    """A span's features as one short code: length and digit share by class, mixed case, quotes."""
    span = text[a:b]
    share = sum(c.isdigit() for c in span) * 4 // len(span)
    mixed = int(any(c.islower() for c in span) and any(c.isupper() for c in span))
    quoted = int(a > 0 and text[a - 1] in "\"'")
    return f"{min(len(span).bit_length(), 8)}{share}{mixed}{quoted}"


def spans_of(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[dict]]:
    """(base spans, all spans with votes and features); candidates never overlap base spans."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = [(kind, a, b, True) for kind in BASE for a, b in base[kind]]
    for kind, pattern in _LOOSE.items():
        if kind != "email" and not _DIGIT.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            before = bisect_left(starts, b)  # base spans that begin before the candidate's end
            if not before or reach[before - 1] <= a:
                out.append((kind, a, b, False))
    return base, [{"kind": k, "a": a, "b": b, "base": is_base, "votes": ",".join(map(str, votes_on(k, text, a, b))), "features": features_of(k, text, a, b)} for k, a, b, is_base in out]


# -- reliabilities and classifier ----------------------------------------------------------------


def fit_reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of being personal data for each vote pattern, by EM over (pattern, count).

    Two classes; each labeler has its own distribution over {-1, 0, 1} in each class, smoothed
    towards a labeler that is right more often than wrong. Starts from the majority of votes.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns]) + 1
    weight = np.array([n for _, n in patterns], float)
    score = (votes - 1).sum(axis=1)
    posterior = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    prior_good, prior_bad = np.array([1.0, 2.0, 3.0]), np.array([3.0, 2.0, 1.0])
    for _ in range(rounds):
        good, bad = weight * posterior, weight * (1 - posterior)
        prior = (good.sum() + 1) / (weight.sum() + 2)
        log_odds = np.full(len(weight), math.log(prior / (1 - prior)))
        for k in range(votes.shape[1]):
            p = np.bincount(votes[:, k], good, 3) + prior_good
            q = np.bincount(votes[:, k], bad, 3) + prior_bad
            log_odds += np.log(p / p.sum())[votes[:, k]] - np.log(q / q.sum())[votes[:, k]]
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}


def _design(kind: str, votes: tuple[int, ...], features: str) -> np.ndarray:
    x = [1.0, *(float(kind == k) for k in KINDS)]
    for v in votes:
        x += [float(v > 0), float(v < 0)]
    length, share, mixed, quoted = map(int, features)
    x += [length / 8, share / 4, float(mixed), float(quoted)]
    return np.array(x)


def fit_classifier(rows: list[tuple[str, tuple[int, ...], str, float]], posterior: dict[str, dict[tuple[int, ...], float]], ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier trained on the posteriors (Newton steps, ridge-smoothed)."""
    width = len(_design(KINDS[0], (0,) * len(LABELERS), "0000"))
    w = np.zeros(width)
    if not rows:
        return w
    x = np.array([_design(k, v, f) for k, v, f, _ in rows])
    y = np.array([posterior[k][v] for k, v, _, _ in rows])
    n = np.array([c for *_, c in rows], float)
    n = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(width)
        w = w + np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * w)
    return w


def vote_counts(marked: DataFrame) -> DataFrame:
    """Counts by (kind, votes, features): at most 7 kinds x 3^5 votes x 180 features rows."""
    return marked.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.features").count()


def train(marked: DataFrame) -> set[str]:
    """The (kind, votes, features) codes of candidates that the final classifier accepts."""
    rows = [(r["kind"], tuple(map(int, r["votes"].split(","))), r["features"], r["count"]) for r in vote_counts(marked).collect()]
    posterior = {}
    for kind in KINDS:
        patterns: Counter = Counter()
        for k, votes, _, n in rows:
            if k == kind:
                patterns[votes] += n
        posterior[kind] = fit_reliabilities(sorted(patterns.items()))
    rows.sort()
    weights = fit_classifier(rows, posterior)
    return {f"{k}|{','.join(map(str, v))}|{f}" for k, v, f, _ in rows if 1 / (1 + math.exp(-float(_design(k, v, f) @ weights))) >= ACCEPT}


_SPAN = "struct<kind:string,a:int,b:int,base:boolean,votes:string,features:string>"


def mark_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_sha256, found): base spans and candidates of every document."""
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())])
        for batch in slices(batches, 1):
            counts, digests, found = {k: [] for k in BASE}, [], []
            for text in as_str(batch.column(1)):
                base, spans = spans_of(text)
                for k in BASE:
                    counts[k].append(len(base[k]))
                listed = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
                digests.append(hashlib.sha256(listed.encode()).hexdigest())
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(found, pa.list_(span))], names)

    schema = f"id {id_type(docs, id_col)}, " + ", ".join(f"n_{k} long" for k in BASE) + f", base_sha256 string, found array<{_SPAN}>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and ``spans``, all of them.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by kind as in ``KINDS``, then
    start. Null and empty texts have none; repeated rows and null identifiers are kept; without
    any candidate in the corpus the base spans are all there is.
    """
    marked = materialize(mark_spans(docs, id_col, text_col))
    accepted = F.array(*map(F.lit, sorted(train(marked)))).cast("array<string>")
    place = F.array(*map(F.lit, KINDS))
    stay = F.filter("found", lambda s: s["base"] | F.array_contains(accepted, F.concat_ws("|", s["kind"], s["votes"], s["features"])))
    ordered = F.array_sort(F.transform(stay, lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    return marked.select(F.col("id").alias(id_col), *(f"n_{k}" for k in BASE), "base_sha256", text.alias("spans"))
