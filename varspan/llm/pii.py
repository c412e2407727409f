"""Personal data and secrets by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns. Further candidates (national phone numbers, identity
numbers, bank accounts, names, addresses, birth dates, secrets, private keys) come from looser patterns, and five labelers
vote on each: the strict form, gazetteers, words that point to the kind before it, clean edges around it, and words that
point to something else (orders, versions, checksums). None is trusted as such: expectation-maximisation over the counts
of vote patterns of the whole table estimates, for each kind, how often a labeler votes so on true and false candidates,
and its posteriors train a logistic span classifier on votes and shape (length, digits, variety of characters).
Candidates that it accepts become spans.

One pass reads the texts and keeps spans and candidates only; the counts of patterns are few at any size.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import sliced, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("national_phone", "identity", "account", "name", "address", "birth_date", "secret", "private_key")
#: Posterior that a candidate needs.
ACCEPT = 0.5
LABELERS = 5

TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Each kind's patterns; a named group `value` is the span, else the whole match.
LOOSE = {
    "national_phone": [re.compile(r"(?<![\w+(.-])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])")],
    "identity": [re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")],
    "account": [re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")],
    "name": [re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)?(?!\w)")],
    "address": [re.compile(r"(?<!\w)\d{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)(?!\w)")],
    "birth_date": [re.compile(r"(?<![\w-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w-])")],
    "secret": [
        re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credentials?)[\"']?[ ]?[:=][ ]?[\"']?(?P<value>[^\s\"'<>=:;,]{6,}+)", re.I),
        re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?!\w)"),
        re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/=_-])"),
    ],
    "private_key": [re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")],
}
#: Patterns whose matches may be plain words: they need a digit and a letter.
MIXED = LOOSE["secret"][2]
POINTERS = {
    "national_phone": re.compile(r"(?:phone|tel|call|mobile|fax|cell|contact)\W*(?:\w+\W+)?$", re.I),
    "identity": re.compile(r"(?:ssn|social security|identity|id)\W*(?:\w+\W+)?$", re.I),
    "account": re.compile(r"(?:iban|account|bank|transfer)\W*(?:\w+\W+)?$", re.I),
    "name": re.compile(r"(?:dear|contact|patient|client|signed|by|name is)\W*$", re.I),
    "address": re.compile(r"(?:address|live at|lives at|living at|reside at|located at|ship to|home)\W*$", re.I),
    "birth_date": re.compile(r"(?:born|birth|dob|birthday)\W*(?:\w+\W+)?$", re.I),
    "secret": re.compile(r"(?:password|passwd|pwd|secret|token|key|auth|bearer|credentials?)\W*$", re.I),
    "private_key": re.compile(r"(?:key|pem)\W*$", re.I),
}
ELSE = re.compile(
    r"(?:order|invoice|version|ticket|isbn|part|price|total|page|figure|serial|published|updated|commit|revision|sha\d*|md5|checksum|"
    r"hash|digest|etag)\W*(?:no|number|#)?\W*$",
    re.I,
)
#: Common given names of four languages.
GIVEN_NAMES = set(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah "
    "charles karen christopher nancy daniel lisa matthew margaret anthony betty mark sandra donald ashley steven kimberly andrew emily "
    "donna joshua michelle kenneth carol kevin amanda brian melissa george deborah timothy stephanie ronald rebecca jason laura edward "
    "helen anna maria hans peter pierre marie jose juan carmen luis sofia paul emma klaus ursula heinz ingrid wolfgang monika juergen "
    "petra stefan sabine andreas renate uwe birgit jean michel nathalie philippe isabelle alain sylvie nicolas catherine francois "
    "monique laurent valerie julien camille antonio ana manuel josefa francisco isabel javier dolores miguel pilar carlos teresa "
    "alejandro lucia pedro elena rafael cristina fernando rosa pablo marta diego raquel".split()
)
COUNTRIES = set("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SI SK".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: each @ looks left over its run, not each run for an @."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        tail = TAIL.match(text, at) if start < at else None
        if tail:
            out.append((start, tail.end()))
            floor = tail.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # no match reaches over this @
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the four fixed kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _strict(kind: str, s: str) -> bool:
    if kind == "account":
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "identity":
        a, b, c = s.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if kind == "national_phone":
        digits = re.sub(r"\D", "", s)
        return digits[0] > "1" and digits[3] > "1"
    if kind == "birth_date":
        parts = [int(p) for p in re.split(r"\D", s)]
        year = parts[0] if parts[0] > 31 else parts[2]
        return 1900 <= year <= 2020
    if kind == "secret":
        return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and variety(s) >= 2.5
    if kind == "private_key":
        return "END" in s
    return len(s.split()) >= 3


def variety(s: str) -> float:
    """Entropy of a string's characters, in bits."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


KNOWN_SECRET = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox|eyJ")


def _known(kind: str, s: str) -> bool:
    if kind == "account":
        return s[:2] in COUNTRIES
    if kind == "name":
        return any(w.lower() in GIVEN_NAMES for w in s.split())
    if kind == "secret":
        return KNOWN_SECRET.match(s) is not None
    return kind == "address" and s.rsplit(" ", 1)[-1] in ("Street", "Avenue", "Road")


def votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """1 (personal), -1 (not) or 0 (no opinion) of the five labelers."""
    found, before = text[start:end], text[max(0, start - 40) : start]
    return [
        1 if _strict(kind, found) else -1,
        1 if _known(kind, found) else 0,
        1 if POINTERS[kind].search(before) else -1 if kind == "secret" and not _known(kind, found) else 0,
        1 if (end == len(text) or text[end] in " .,;:!?)\n\"'") and (start == 0 or text[start - 1] in " (:=\n\"'") else -1,
        -1 if ELSE.search(before) else 0,
    ]


def shape(found: str) -> list[int]:
    """Bins of a candidate's form: bits of its length, quarters of digits, bits of character variety (long ones: of 256 characters)."""
    return [len(found).bit_length(), 4 * sum(map(str.isdigit, found)) // len(found), int(variety(found[:256]))]


SHAPES = 3


def disjoint(taken: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts, ends = [], []
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, str, int, list[int], list[int]]]:
    """(start, kind, end, votes, shape) of what the loose patterns find outside the base spans, sorted. Of overlapping
    candidates of one kind the leftmost stays (of one start the longest); kinds may overlap."""
    starts, ends = disjoint(taken)

    def free(s: int, e: int) -> bool:
        i = bisect_right(starts, s) - 1
        return not (i >= 0 and ends[i] > s) and not (i + 1 < len(starts) and starts[i + 1] < e)

    out = []
    for kind, patterns in LOOSE.items():
        spans = []
        for pattern in patterns:
            group = "value" if "value" in pattern.groupindex else 0
            for m in pattern.finditer(text):
                s, e = m.span(group)
                if pattern is MIXED and not (any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0]))):
                    continue
                if free(s, e):
                    spans.append((s, -e))
        floor = 0
        for s, e in sorted(spans):
            if s >= floor:
                floor = -e
                out.append((s, kind, -e, votes(kind, text, s, -e), shape(text[s:-e])))
    return sorted(out)


FOUND = (
    "doc_id long, base array<struct<start:int,kind:string,end:int>>, "
    "more array<struct<start:int,kind:string,end:int,votes:array<int>,shape:array<int>>>"
)


def _find(batches):
    import pyarrow as pa

    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    more_type = pa.list_(
        pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32()))])
    )
    for batch in batches:
        for part in sliced(batch, "text"):
            base, more = [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": BASE[k], "end": e} for s, k, e in spans])
                more.append([{"start": s, "kind": k, "end": e, "votes": v, "shape": f} for s, k, e, v, f in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(base, base_type), pa.array(more, more_type)], names=["doc_id", "base", "more"]
            )


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50):
    """Expectation-maximisation over (votes, count): the posterior of each vote pattern that the candidate is true.

    Votes are taken as independent given the truth; true candidates are taken to get more votes for than against.
    """
    import numpy as np

    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    balance = v.sum(axis=1)
    p = 1 / (1 + np.exp(-(balance - 0.5)))
    for _ in range(rounds):
        prior = np.clip(((p * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99)
        yes, no = np.full(len(v), np.log(prior)), np.full(len(v), np.log(1 - prior))
        for j in range(v.shape[1]):
            for value in (-1, 0, 1):
                own = v[:, j] == value
                # two rows' worth of the belief that a vote is right more often than not keeps the classes apart
                yes[own] += np.log(((p * n)[own].sum() + 1 + 0.5 * value) / ((p * n).sum() + 3))
                no[own] += np.log((((1 - p) * n)[own].sum() + 1 - 0.5 * value) / (((1 - p) * n).sum() + 3))
        new = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def train(found: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier for each kind: five votes, their products with a cue before, the shape, and an
    intercept. Every pattern counts as true by its posterior and as false by the rest, as often as it occurs."""
    import numpy as np

    from varspan.llm.toxicity import fit_logistic

    counted = found.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    model = {}
    for kind in ADDED:
        rows = [(tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in counted if r["kind"] == kind]
        if not rows:
            continue
        by_votes = Counter()
        for v, _, n in rows:
            by_votes[v] += n
        patterns = sorted(by_votes.items())
        posterior = dict(zip([v for v, _ in patterns], reliabilities(patterns)))
        x = np.array([features(v, f) for v, f, _ in rows], dtype=float)
        n = np.array([c for _, _, c in rows], dtype=float)
        q = np.array([posterior[v] for v, _, _ in rows])
        both, y = np.vstack([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))])
        model[kind] = [float(a) for a in fit_logistic(both, y, counts=np.concatenate([n * q, n * (1 - q)]) + 1e-3)]
    return model


def features(v, f) -> list[float]:
    return [*map(float, v), float(v[0] * v[2]), float(v[0] * v[4]), *map(float, f)]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans (arrays of start, kind, end in code points, end exclusive) for every row of docs.

    base holds the fixed kinds, spans these and the candidates that the classifier accepts, sorted by start and kind.
    Null text is empty and has none. Repeated rows get equal spans; an empty table gives none; other columns are
    ignored.
    """
    found = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, FOUND), "pii-found"
    )
    model = train(found)

    def accepted(c):
        out = F.lit(False)
        for kind, w in model.items():
            v = c["votes"]
            terms = [*[v[i] for i in range(LABELERS)], v[0] * v[2], v[0] * v[4], *[c["shape"][i] for i in range(SHAPES)]]
            logit = sum((t.cast("double") * a for t, a in zip(terms, w)), F.lit(w[-1]))
            out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-logit)) >= ACCEPT).otherwise(out)
        return out

    chosen = F.transform(
        F.filter("more", accepted),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", chosen), _before).alias("spans"))


def _order(kind):
    names = [*BASE, *ADDED]
    return F.array_position(F.array(*[F.lit(k) for k in names]), kind)


def _before(a, b):
    x, y = F.struct(a["start"], _order(a["kind"]), a["end"]), F.struct(b["start"], _order(b["kind"]), b["end"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _listed(column):
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_pii(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") > 0).alias("flagged"),
    )
