"""Secret scans: candidate strings in whole texts, judged by a random forest.

A candidate is (a) a run of 16 or more characters of a-z, A-Z, 0-9, + / _ . - with a digit in it and the = signs
after it, (b) the value of at least 8 characters that is assigned to a name with a credential word, (c) a private key
block, with or without header lines, (d) the password in an address, or (e) 16 or more such characters, digits or
not, after the name of an authorisation scheme. None has an upper limit of length. Features are the candidate's
length, its character transitions and entropy, how much of it dictionary words cover, whether it lies in
a path or address, and the words beside it. The forest is trained on labelled findings and drops the
false ones: digests, identifiers, placeholders, paths, long words.

Defined cases: a null or empty text has no candidates; overlapping candidates are judged each on its own and
count once, and those of them that are secrets make one span; repeated rows and null ids keep their rows; extra columns are ignored; an empty table gives no rows.
Offsets count code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import fresh, texts
from weftlink.llm.secret_findings import CREDENTIAL_WORDS, DICTIONARY, HARMLESS_WORDS, STAND_INS, generated_findings
from weftlink.llm.trees import Binned, Tree

_RUN = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{16,}+={0,2}")
_ADDRESS = re.compile(r"://[^\s/:@\"'<>]*+:([^\s/@\"']{6,}+)@")
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token)[ \t]{1,3}(?=([A-Za-z0-9+/_.~\-]{16,}+={0,2}))")
_ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(CREDENTIAL_WORDS)})[\w.\-]{{0,20}}[\"']?\s{{0,3}}(?:[:=]|=>|:=)\s{{0,3}}(?:[\"']([^\"'\n]{{8,}}+)[\"']|([^\s\"',;<>]{{8,}}+))")
_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----")
#: What stands between the marks: header lines, if any, then base64; line breaks may be escaped.
_BODY = re.compile(r"(?:(?:\s|\\[nrt])*+[A-Za-z][A-Za-z0-9\-]*+:[^\n\\]*+(?=[\n\\]))*+[A-Za-z0-9+/=\s\\]{16,}+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NEAR = re.compile(r"[a-z]+")
_PREFIXES = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ|SG\.|npm_|pypi-)")
_WORDS = sorted(DICTIONARY, key=len, reverse=True)
_DICTIONARY = re.compile("|".join(_WORDS))
_CREDENTIALS, _HARMLESS = tuple(CREDENTIAL_WORDS), frozenset(HARMLESS_WORDS)
_PASSWORDS = ("password", "passwd", "pwd", "passphrase", "secret")


@dataclass(frozen=True)
class SecretParams:
    trees: int = 40
    depth: int = 9
    least: int = 2
    features: int = 5  #: random columns that each node looks at
    findings: int = 6000  #: labelled findings that are learnt from at most
    threshold: float = 0.5
    context: int = 60  #: characters before and after a candidate
    mask: str = "[SECRET]"
    seed: int = 7


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks: each END mark with the last BEGIN mark before it, so that every body is read once."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin:
            if _BODY.fullmatch(text, begin.end(), m.start()):
                yield begin.start(), m.end()
            begin = None


def all_candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, each span once; they may overlap."""
    found = [(m.start(), m.end(), "run") for m in _RUN.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(m.lastindex), m.end(m.lastindex), "assigned") for m in _ASSIGNED.finditer(text)]
    if "://" in text:
        found += [(*m.span(1), "address") for m in _ADDRESS.finditer(text)]
    found += [(*m.span(1), "scheme") for m in _SCHEME.finditer(text)]
    if "-----BEGIN" in text:
        found += [(s, e, "block") for s, e in _blocks(text)]
    found.sort(key=lambda x: (x[0], -x[1], x[2]))
    return [x for i, x in enumerate(found) if not i or x[:2] != found[i - 1][:2]]


def _longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for x in found:
        if out and x[0] < out[-1][1]:
            if x[1] - x[0] > out[-1][1] - out[-1][0]:
                out[-1] = x
        else:
            out.append(x)
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, not overlapping: of those that overlap the longer."""
    return _longest(all_candidates(text))


def _merged(secrets: list[tuple[int, int, str, float]]) -> list[dict]:
    """Secrets that overlap as one span, with the kind of the longest and the highest score."""
    out: list[dict] = []
    most = 0
    for s, e, kind, score in secrets:
        if out and s < out[-1]["start"] + out[-1]["length"]:
            last = out[-1]
            last["length"] = max(last["length"], e - last["start"])
            last["score"] = max(last["score"], score)
            if e - s > most:
                last["kind"], most = kind, e - s
        else:
            out.append({"start": s, "length": e - s, "kind": kind, "score": score})
            most = e - s
    return out


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


#: Common pairs of letters in words; runs that follow them read like language.
_PAIRS = frozenset(a + b for w in DICTIONARY for a, b in zip(w, w[1:]))


def features(text: str, start: int, end: int, context: int) -> list[float]:
    value = text[start:end].strip(".")
    n = max(1, len(value))
    low = value.lower()
    kinds = [_kind(c) for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = [(a, b) for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:]))
    before, after = text[max(0, start - context):start], text[end:end + context]
    head = before.rstrip()
    words = _NEAR.findall(before.lower())[-6:]
    beside = {*words, *_NEAR.findall(after.lower())[:3]}
    named = next((i for i, w in enumerate(reversed(words)) if w.endswith(_CREDENTIALS)), 9)
    space = max(before.rfind(" "), before.rfind("\n"), before.rfind('"'))
    joined = before[space + 1:] + value
    return [
        n, entropy, entropy / max(1.0, math.log2(n)), turns / n,
        sum(a + b in _PAIRS for a, b in letters) / len(letters) if letters else 0.0,
        sum(len(m) for m in _DICTIONARY.findall(low)) / n,
        kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        sum(c in "0123456789abcdef" for c in low) / n, steps / n, len(counts) / min(n, 64),
        value.count("/") + value.count("\\"), float("://" in joined or joined.startswith(("/", "./", "www."))), float(bool(re.search(r"\.[a-z]{2,4}$", low))),
        float(bool(_UUID.fullmatch(value))), float(bool(_PREFIXES.match(value))), float("PRIVATE KEY" in value),
        float(named), float(len(beside & _HARMLESS)), float(head.endswith(("=", ":", '="', "='", ':"', ": \"", "= \"", "= '", "=>"))), float(before.endswith(('"', "'", "`"))),
        float(bool(words) and words[-1].endswith(_PASSWORDS)), value.count(" ") / n, sum(w in low for w in STAND_INS), float(value[:1] in "$<{%*"), float(after.startswith("@")),
    ]


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    params: SecretParams

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def train_forest(findings: list[tuple[str, int, int, int]], params: SecretParams = SecretParams()) -> Forest:
    """A forest from labelled findings (text, start, end, 1 for a secret or 0); without any, every candidate counts."""
    p = params
    findings = findings[:p.findings]
    if not findings:
        return Forest((), p)
    x = np.asarray([features(t, s, e, p.context) for t, s, e, _ in findings])
    y = np.asarray([float(label) for *_, label in findings])
    rng = np.random.default_rng(p.seed)
    binned = Binned(x, 64)
    return Forest(tuple(binned.grow(y, rng.integers(0, len(y), len(y)), rng, p.depth, p.least, p.features) for _ in range(p.trees)), p)


def default_forest(params: SecretParams = SecretParams()) -> Forest:
    return train_forest(generated_findings(params.findings, params.seed), params)


FOUND = "struct<n_candidates:long,secrets:array<struct<start:long,length:long,kind:string,score:double>>,redacted:string>"


def secret_findings(text: Column, forest: Forest) -> Column:
    """For each text: candidates, secrets among them, and the text with secrets masked (null where there are none)."""
    p = forest.params

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, rows = [], []
            for t in batch:
                own = all_candidates(t or "")
                found.append(own)
                rows += [features(t, s, e, p.context) for s, e, _ in own]
            scores = iter(forest.scores(np.asarray(rows)).tolist() if rows else ())
            out = []
            for t, own in zip(batch, found):
                kept = _merged([(*x, score) for x, score in zip(own, scores) if score >= p.threshold])
                masked = None
                if kept:
                    parts, at = [], 0
                    for k in kept:
                        parts += [t[at:k["start"]], p.mask]
                        at = k["start"] + k["length"]
                    masked = "".join(parts) + t[at:]
                out.append((len(_longest(own)), kept, masked))
            yield pd.DataFrame(out, columns=["n_candidates", "secrets", "redacted"])

    return F.pandas_udf(scan, FOUND)(text)


def scan_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_candidates, n_secrets, max_score, secrets (start, length, kind, score). No shuffle."""
    rows = texts(docs, id_col, text_col).select("doc_id", secret_findings(F.col("text"), forest).alias("found"))
    return rows.select("doc_id", "found.n_candidates", F.size("found.secrets").cast("long").alias("n_secrets"),
                       F.array_max(F.col("found.secrets.score")).alias("max_score"), "found.secrets")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in its texts, and lengths of changed texts put right; all rows and columns stay."""
    name = fresh(docs, "found")
    out = docs.withColumn(name, secret_findings(F.col(text_col), forest)["redacted"])
    changed = F.col(name).isNotNull()
    columns = {text_col: F.coalesce(F.col(name), F.col(text_col))}
    if length_col in docs.columns:
        columns[length_col] = F.when(changed, F.length(name).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.withColumns(columns).drop(name)
