"""Search-strategy compiler: concept model and host dialect to a query string, and a linter.

A concept model has blocks (id, terms, vocab, truncation, proximity) and a flat operator
logic. Dialects and proximity shells are small driver-side tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.scratch import spread

# How a host counts words between terms, and its proximity operator.
PROXIMITY = {
    "cochrane": ("gap_plus_one", "NEAR/{n}"),
    "ovid": ("gap_plus_one", "adj{n}"),
    "embase_com": ("gap_plus_one", "NEAR/{n}"),
    "ebsco": ("gap", "N{n}"),
    "proquest": ("gap", "NEAR/{n}"),
    "scopus": ("gap", "W/{n}"),
    "wos": ("gap", "NEAR/{n}"),
    "pubmed": ("gap", '"{terms}"[{field}:~{n}]'),
    "ieee": ("gap", "NEAR/{n}"),
    "cabi": ("gap", '"{terms}"~{n}'),
    "cnki": ("gap", "/NEAR {n}"),
    "acm": (None, None),
    "clinicaltrials_gov": (None, None),
    "wanfang": (None, None),
    "eric": (None, None),
}


@dataclass(frozen=True)
class Dialect:
    """style: bracket (term[tag]), paren (TAG(term)), equals (TAG=term), colon (tag:term), bare."""

    host: str
    style: str
    tag: str
    truncation: str | None
    least_stem: int
    vocab: str | None
    vocab_shape: str | None
    link: str | None = None


# The dialects' tags, truncation signs and link templates.
DIALECTS = {
    d.host: d
    for d in (
        Dialect("pubmed", "bracket", "tiab", "*", 4, "MeSH", '"{term}"[mh]', "https://pubmed.ncbi.nlm.nih.gov/?term={q}"),
        Dialect("scopus", "paren", "TITLE-ABS-KEY", "*", 1, None, None),
        Dialect("wos", "equals", "TS", "*", 1, None, None),
        Dialect("eric", "bare", "", None, 1, "ERIC", 'descriptor:"{term}"', "https://eric.ed.gov/?q={q}"),
        Dialect("ovid", "bare", "", "*", 1, "MeSH", "exp {term}/"),
        Dialect("ebsco", "bare", "", "*", 1, "CINAHL", '(MH "{term}+")'),
        Dialect("cochrane", "colon", "ti,ab,kw", "*", 1, "MeSH", '[mh "{term}"]'),
        Dialect("clinicaltrials_gov", "bare", "", None, 1, None, None, "https://clinicaltrials.gov/search?term={q}"),
    )
}


def parse_logic(text: str) -> tuple[list[str], str]:
    """Block ids and the one operator that joins them; ValueError for mixed or missing ones."""
    parts = text.split()
    ids, ops = parts[::2], {p.upper() for p in parts[1::2]}
    if not ids or len(parts) % 2 == 0 or len(ops) > 1 or not ops <= {"AND", "OR"}:
        raise ValueError(f"not a flat AND or OR of block ids: {text!r}")
    return ids, (ops or {"AND"}).pop()


def host_n(host: str, gap: int) -> int | None:
    kind = PROXIMITY.get(host, (None, None))[0]
    return None if kind is None else gap + (kind == "gap_plus_one")


def gap_of(host: str, n: int) -> int | None:
    kind = PROXIMITY.get(host, (None, None))[0]
    return None if kind is None else n - (kind == "gap_plus_one")


def equivalent(host_a: str, n_a: int, host_b: str, n_b: int) -> bool:
    a, b = gap_of(host_a, n_a), gap_of(host_b, n_b)
    return a is not None and a == b


def proximity(host: str, terms: list[str], gap: int, field: str = "tiab") -> tuple[str, str | None]:
    """The clause, and a note where the host has no such operator and AND stands in."""
    n, shell = host_n(host, gap), PROXIMITY.get(host, (None, None))[1]
    if n is None or shell is None:
        return "(" + " AND ".join(terms) + ")", "no proximity operator; AND is used"
    if "{terms}" in shell:
        return shell.format(terms=" ".join(terms), field=field, n=n), None
    return "(" + f" {shell.format(n=n)} ".join(terms) + ")", None


def quoted(term: str) -> str:
    return f'"{term}"' if re.search(r"\s", term) and not term.startswith('"') else term


def render_term(d: Dialect, term: str, stem: str | None = None) -> str:
    body = stem + d.truncation if stem and d.truncation and len(stem) >= d.least_stem else quoted(term)
    return {"bracket": f"{body}[{d.tag}]", "paren": f"{d.tag}({body})", "equals": f"{d.tag}={body}", "colon": f"{body}:{d.tag}", "bare": body}[d.style]


def render_block(d: Dialect, block: dict, known: dict[str, set[str]]) -> tuple[str, list[str]]:
    """The block's clause and points to review; vocabulary terms must be in ``known``."""
    stems, notes, parts = block.get("truncation", {}), [], []
    for term in block["terms"]:
        parts.append(render_term(d, term, stems.get(term)))
    if near := block.get("proximity"):
        clause, note = proximity(d.host, near["terms"], near["gap"])
        parts.append(clause)
        notes += [note] if note else []
    if d.vocab:
        for term in block.get("vocab", {}).get(d.vocab, []):
            if term in known.get(d.vocab, set()):
                parts.append(d.vocab_shape.format(term=term))
            else:
                notes.append(f"{d.vocab} term not verified: {term}")
    return "(" + " OR ".join(parts) + ")", notes


def compile_strategy(model: dict, host: str, known: dict[str, set[str]] | None = None) -> dict:
    """query, link, status (ready or withheld), reasons and review points of one host."""
    d, reasons, notes, text = DIALECTS[host], [], [], ""
    try:
        ids, op = parse_logic(model["operator_logic"])
        blocks = {b["id"]: b for b in model["blocks"]}
        made = [render_block(d, blocks[i], known or {}) for i in ids]
        text = f" {op} ".join(t for t, _ in made)
        notes = [n for _, more in made for n in more]
    except (KeyError, ValueError) as e:
        reasons.append(str(e))
    errors = [f for f in lint(text, host) if f[1] == "error"] if text else []
    reasons += [f"{rule}: {message}" for rule, _, message in errors]
    ready = bool(text) and not reasons
    link = d.link.format(q=quote_plus(text)) if ready and d.link else None
    return {"host": host, "query": text if ready else None, "link": link, "status": "ready" if ready else "withheld", "reasons": reasons, "review": notes}


def _unquoted(query: str) -> str:
    return re.sub(r'"[^"]*"', lambda m: " " * len(m.group()), query)


def lint(query: str, host: str) -> list[tuple[str, str, str]]:
    """(rule, level, message) of what a dialect can't take."""
    d, out, bare = DIALECTS.get(host), [], _unquoted(query)
    depth = 0
    for ch in bare:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            break
    if depth or query.count('"') % 2:
        out.append(("L1", "error", "brackets or quotes don't balance"))
    if re.search(r"(?<![\w])(and|or|not)(?![\w])", bare):
        out.append(("L2", "warning", "operator in lower case"))
    if "*" in query and d and not d.truncation:
        out.append(("L3", "error", "the host has no truncation"))
    if d and d.truncation:
        for stem in re.findall(r"(\w+)\*", query):
            if len(stem) < d.least_stem:
                out.append(("L3", "error", f"stem too short: {stem}"))
    shells = {"NEAR": r"\bNEAR/\d+", "adj": r"\badj\d*\b", "W": r"\bW/\d+", "N": r"\bN\d+\b"}
    mine = PROXIMITY.get(host, (None, None))[1] or ""
    for name, pattern in shells.items():
        if re.search(pattern, bare) and not mine.startswith(name):
            out.append(("L4", "error", f"not the host's proximity operator: {name}"))
    tags = re.findall(r"\[([a-z]{2,6})(?::~\d+)?\]", bare if host != "pubmed" else query)
    for tag in tags:
        if not d or d.style != "bracket":
            out.append(("L5", "error", f"field tag of another host: [{tag}]"))
    if re.search(r"\{\{|\}\}|\bTODO\b", query):
        out.append(("L6", "error", "template marker left in the query"))
    if re.search(r"[（）“”＂０-９Ａ-Ｚａ-ｚ]", query):
        out.append(("L7", "error", "full-width characters"))
    if re.search(r"(?<![A-Za-z])NOT(?![A-Za-z])", bare):
        out.append(("L8", "warning", "NOT may drop relevant records"))
    if host == "cochrane" and re.search(r"randomi[sz]ed controlled trial|\bRCT\b", query, re.I):
        out.append(("L9", "error", "trial filter on a register of trials"))
    defined = [int(m) for m in re.findall(r"(?m)^#?(\d+)[.)\s]", query)] if "\n" in query else []
    used = {int(m) for m in re.findall(r"#(\d+)", query)}
    out += [("L10", "warning", f"line {k} isn't used") for k in defined[:-1] if k not in used]
    if re.search(r"\[(?:mh|majr)\]", query) and host != "pubmed":
        out.append(("L11", "error", "vocabulary tag of another host"))
    return out


def vocabulary_status(statuses: list[str]) -> str:
    """Any pending: pending; some verified and some not found: downgraded."""
    kinds = set(statuses)
    if not kinds:
        return "none"
    if "pending" in kinds:
        return "pending"
    return "downgraded" if {"verified", "not_found"} <= kinds else "verified" if kinds == {"verified"} else "not_found"


def stateless_rules(c: Column) -> dict[str, Column]:
    """L1, L6 and L8 as Columns, for tables of queries."""
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return {"l1": (count('"') % 2 == 1) | (count("(") != count(")")), "l6": F.contains(c, F.lit("{{")) | F.contains(c, F.lit("}}")), "l8": c.rlike(r"\bNOT\b")}


def _counts(host: Column, kind: str) -> Column:
    return host.isin(*[h for h, (k, _) in PROXIMITY.items() if k == kind])


def host_distance(host: Column, gap: Column) -> Column:
    """What a host is told for at most ``gap`` words between two terms; null where it has no operator."""
    return F.when(_counts(host, "gap"), gap).when(_counts(host, "gap_plus_one"), gap + 1)


def words_between(host: Column, n: Column) -> Column:
    """The inverse of ``host_distance``."""
    return F.when(_counts(host, "gap"), n).when(_counts(host, "gap_plus_one"), n - 1)


SAMPLES = [("(a OR b", "pubmed"), ("heart* AND attack", "eric"), ("a NEAR/3 b", "scopus"), ("x[tiab] NOT y[tiab]", "pubmed"), ("（癌症）", "scopus"), ("asthma AND RCT", "cochrane"), ("{{term}}", "wos"), ("ab* AND c", "pubmed")]


def lint_frame(rows: DataFrame, query: str, host: str) -> DataFrame:
    """The findings of each row's query: its columns with rule, level and message."""

    @F.pandas_udf("array<struct<rule:string,level:string,message:string>>")
    def found(queries: pd.Series, hosts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("rule", "level", "message"), f, strict=True)) for f in lint(q, h)] for q, h in zip(queries, hosts, strict=True)])

    return rows.withColumn("_f", F.explode(found(F.col(query), F.col(host)))).select(*rows.columns, "_f.*")


def compile_frame(rows: DataFrame, key: str, synonyms: list[str], other: str, gap: str) -> DataFrame:
    """key, host, query, link, status and review of each row's concept model, for every host: a block
    of ``synonyms`` and one of ``other`` near the first synonym, at most ``gap`` words between."""
    kind = "struct<query:string,link:string,status:string,review:array<string>>"

    @F.pandas_udf(kind)
    def compiled(hosts: pd.Series, terms: pd.Series, others: pd.Series, gaps: pd.Series) -> pd.DataFrame:
        out = []
        for host, first, second, most in zip(hosts, terms, others, gaps, strict=True):
            blocks = [{"id": "A", "terms": list(first)}, {"id": "B", "terms": [second], "proximity": {"terms": [quoted(first[0]), second], "gap": int(most)}}]
            out.append(compile_strategy({"blocks": blocks, "operator_logic": "A AND B"}, host))
        return pd.DataFrame(out, columns=["query", "link", "status", "review"])

    each = spread(rows.select(key, *synonyms, other, gap)).withColumn("host", F.explode(F.array(*[F.lit(h) for h in DIALECTS])))
    return each.withColumn("_c", compiled("host", F.array(*synonyms), other, gap)).select(key, "host", "_c.*")
