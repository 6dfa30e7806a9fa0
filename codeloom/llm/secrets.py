"""Operator 9: secrets by patterns and by token efficiency.

Three base patterns find assignments, access keys and hexadecimal strings. The method adds random-looking strings: candidates are
runs of [A-Za-z0-9+/_=-] of LEAST characters or more with letters, and one is reported when a tiktoken vocabulary needs
so many tokens that it yields fewer than RATIO characters a token, as text and
identifiers do not. Where the whole run yields more, what lies between its marks /, =, _ and - is held against RATIO as well, alone
or in neighbouring parts that make LEAST characters, so that readable text beside a key does not hide it. Left out are what overlaps
a base span, digests of known lengths, UUIDs, time stamps, and identifiers (words, with numbers, joined by marks). Base spans always
stay.

Null text counts as empty: no spans, spans '' and the hash of ''. Positions are code points, ends exclusive. Repeated rows get equal
answers; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST, RATIO = 20, 2.2
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}([T_-]?[0-9-]*Z?)?")
PART = re.compile(r"[A-Za-z0-9+]+")
IDENTIFIER = re.compile(r"([A-Za-z]{3,}[0-9]{0,4}|[0-9]{1,4})([_/=+-]+([A-Za-z]{3,}[0-9]{0,4}|[0-9]{1,4}))+")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def excluded(s: str) -> bool:
    """Digests, UUIDs, time stamps and identifiers."""
    return bool((len(s) in DIGESTS and DIGEST.fullmatch(s)) or UUID.fullmatch(s) or TIME.fullmatch(s) or IDENTIFIER.fullmatch(s))


def assigned(text: str) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not ("passw" in low or "secret" in low or "token" in low or "api" in low):
        return []
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by the base patterns."""
    found = assigned(text)
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]  # runs of [0-9a-f], matched whole, of 24 and more
    return sorted(found)


def poor(s: str, enc) -> bool:
    return any(c.isalpha() for c in s) and len(s) / len(enc.encode_ordinary(s)) < RATIO


def random_parts(run: str, enc) -> list[tuple[int, int]]:
    """The run if it is random-looking, or else its parts, or neighbouring parts together, that are."""
    if not excluded(run) and poor(run, enc):
        return [(0, len(run))]
    if (len(run) in DIGESTS and DIGEST.fullmatch(run)) or TIME.fullmatch(run):
        return []
    known = [m.span() for m in UUID.finditer(run)]
    parts = [m.span() for m in PART.finditer(run) if not any(x < m.end() and m.start() < y for x, y in known)]
    parts = [(a, b) for a, b in parts if not (b - a in DIGESTS and DIGEST.fullmatch(run[a:b]))]
    found: list[list[int]] = []  # numbers of first and last parts
    end = 0
    for i in range(len(parts)):
        end = max(end, i)
        while end + 1 < len(parts) and parts[end][1] - parts[i][0] < LEAST and PART.search(run, parts[end][1]).start() == parts[end + 1][0]:
            end += 1
        a, b = parts[i][0], parts[end][1]
        if b - a >= LEAST and not excluded(run[a:b]) and poor(run[a:b], enc):
            if found and i <= found[-1][1]:
                found[-1][1] = end
            else:
                found.append([i, end])
    out = []
    for i, j in found:
        while i < j and parts[j][1] - parts[i + 1][0] >= LEAST and not poor(run[slice(*parts[i])], enc):
            i += 1
        while i < j and parts[j - 1][1] - parts[i][0] >= LEAST and not poor(run[slice(*parts[j])], enc):
            j -= 1
        while j + 1 < len(parts) and parts[j + 1][0] == parts[j][1] + 1 and poor(run[slice(*parts[j + 1])], enc):
            j += 1
        if not out or parts[i][0] >= out[-1][1]:
            out.append((parts[i][0], parts[j][1]))
    return out


def spans(text: str, enc) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        for x, y in random_parts(m[0], enc):
            if not any(p < a + y and a + x < q for p, _, q in base):
                more.append((a + x, 3, a + y))
    return base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, base (string), spans (string), found (array of kind, start, end)."""

    def make():
        enc = encoding(path, pattern)

        def f(doc_ids, texts):
            out = {"doc_id": doc_ids, "base": [], "spans": [], "found": []}
            for t in texts:
                t = t or ""
                # the other patterns need a long word
                base, every = spans(t, enc) if max(map(len, t.split()), default=0) >= LEAST else (assigned(t),) * 2
                out["base"].append(joined(base))
                out["spans"].append(joined(every))
                out["found"].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every])
            return out

        return f

    return map_texts(docs, "doc_id long, base string, spans string, found array<struct<kind: string, start: long, end: long>>", make)


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
