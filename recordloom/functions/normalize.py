"""Normalisation of identifiers, titles and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# DOI prefixes, generic titles, stopwords, script ranges.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
GENERIC_TITLES = (
    "introduction", "editorial", "preface", "foreword", "conclusion", "conclusions", "erratum", "corrigendum",
    "correction", "retraction", "reply", "response", "commentary", "comment", "discussion", "overview", "abstract",
    "abstracts", "summary", "index", "untitled", "frontmatter", "backmatter",
)
STOPWORDS = tuple(
    "a an and are as at be but by for from has have in into is it its of on or that the their to was were will with "
    "within without between among across over under about via per vs versus using used use based study studies "
    "research review analysis effect effects role".split()
)
#: Han with the extension planes, as queries are split; titles keep the basic plane alone.
QUERY_HAN = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{2ffff}\\x{2f800}-\\x{2fa1f}"
HAN, KANA, HANGUL = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff", "\\u3040-\\u30ff", "\\uac00-\\ud7af"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def doi(c: Column) -> Column:
    """Trimmed, lower-cased, without resolver prefixes (wherever they stand) and arXiv versions."""
    out = F.lower(F.trim(c))
    for prefix in DOI_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return blank_to_null(F.when(F.contains(out, F.lit("10.48550/arxiv.")), F.regexp_replace(out, r"(10\.48550/arxiv\.[\w.\-]+?)v\d+$", "$1")).otherwise(out))


def doi_for_lookup(c: Column) -> Column:
    """The form that lookup joins use; null for arXiv's own DOIs."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(dx\.)?doi\.org/", ""), r"^doi:", "")
    return F.when(~F.contains(out, F.lit("arxiv")), blank_to_null(out))


def arxiv_id(c: Column) -> Column:
    out = F.regexp_replace(F.trim(c), r"^(https?://)?arxiv\.org/(abs|pdf)/", "")
    return blank_to_null(F.regexp_replace(F.regexp_replace(out, r"\.pdf$", ""), r"v\d+$", ""))


def title(c: Column) -> Column:
    """Lower-cased, without a parenthesis at the very end; Latin letters, digits and CJK stay."""
    out = F.regexp_replace(F.lower(c), r"\([^)]*\)[\t\n\f\r ]*\z", "")
    return F.regexp_replace(out, f"[^a-z0-9{HAN}{KANA}{HANGUL}]", "")


def title_key(c: Column) -> Column:
    """Words joined by single spaces, any script."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", " "))


def issn(c: Column) -> Column:
    """XXXX-XXXX, or null."""
    raw = F.upper(F.regexp_replace(c, "[^0-9xX]", ""))
    return F.when(F.length(raw) == 8, F.concat(F.substring(raw, 1, 4), F.lit("-"), F.substring(raw, 5, 4)))


def issns(c: Column) -> Column:
    """The distinct valid ISSNs of a separated list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,/;]"), issn), lambda x: x.isNotNull()))


def bare_issn(c: Column) -> Column:
    return F.replace(issn(c), F.lit("-"), F.lit(""))


def tokens(c: Column, least: int = 1) -> Column:
    """The distinct Latin words of a text, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) >= least))


def significant_tokens(c: Column) -> Column:
    return F.filter(tokens(c, 3), lambda t: ~t.isin(*STOPWORDS))


def query_terms(c: Column) -> Column:
    """Distinct Latin terms of three letters or more without stopwords, then 2-grams of Han runs."""
    latin = F.filter(tokens(c, 3), lambda t: ~t.isin(*STOPWORDS))
    runs = F.regexp_extract_all(c, F.lit(f"[{QUERY_HAN}]+"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(latin, grams))


def language_tag(c: Column) -> Column:
    return F.when(c.rlike("[\\u3041-\\u30ff]"), "en").when(c.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{QUERY_HAN}]"), F.lit(False))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def display_title(c: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(~F.lower(one_line(c)).isin(*GENERIC_TITLES), blank_to_null(one_line(c))), one_line(fallback))


def authors_short(names: Column) -> Column:
    """0: ''; 1: the name; 2: both; 3 or 4: all, the last after "&"; 5 and more: the first et al."""
    n = F.size(names)
    return (
        F.when(n <= 0, "").when(n <= 2, F.array_join(names, ", "))
        .when(n <= 4, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))
        .otherwise(F.concat(names[0], F.lit(" et al.")))
    )


def authors_list(names: Column) -> Column:
    """Up to four names in full, more as the first et al."""
    return F.when(F.size(names) > 4, F.concat(names[0], F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def filter_value(c: Column) -> Column:
    """A query as a filter value: commas to spaces, pipes to OR."""
    return F.replace(F.replace(c, F.lit(","), F.lit(" ")), F.lit("|"), F.lit(" OR "))


def narrow_query(c: Column) -> Column:
    """Whether a query has six or more bare or quoted terms (neither stopwords nor operators) and no OR."""
    terms = F.regexp_extract_all(c, F.lit(r'"[^"]+"|[^\s"()]+'), 0)
    kept = F.filter(terms, lambda t: ~F.lower(t).isin(*STOPWORDS) & ~t.isin("AND", "OR", "NOT"))
    return (F.size(kept) >= 6) & ~c.rlike(r"\bOR\b|\|")


def strip_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def percent_encoded(c: Column) -> Column:
    return F.url_encode(c)


# ---- query strings of single sources -----------------------------------------------------------

# Words and operators of the sources' query languages.
PLAIN_STOPWORDS = ("a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "with", "by", "via", "from")
FIELD_PREFIXES = ("ti", "abs", "all", "au", "cat", "co", "jr", "rn", "id")
FIELD_CODES = ("IKTE", "IKST", "IKSE")


def _pieces(c: Column) -> Column:
    """The words and quoted phrases (with their quotes) of a query, in order."""
    return F.regexp_extract_all(c, F.lit(r'"[^"]+"|\S[^\s"]*'), 0)


def _is_phrase(p: Column) -> Column:
    return p.rlike(r'^"[^"]+"$')


def required_terms(c: Column) -> Column:
    """A plain query with every term required; one with operators or field prefixes is as written.
    Where a quote lacks its pair, quotes go and what they held are words."""
    odd = F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 1
    query = F.when(odd, F.array_join(_pieces(F.replace(c, F.lit('"'), F.lit(" "))), " ")).otherwise(c)
    operator = rf"^[()]*(AND|OR|ANDNOT)[()]*$|^[(]*({'|'.join(FIELD_PREFIXES)}):"
    written = ~odd & F.exists(_pieces(c), lambda p: ~_is_phrase(p) & p.rlike(operator))
    terms = F.filter(_pieces(query), lambda p: _is_phrase(p) | ~F.lower(p).isin(*PLAIN_STOPWORDS))
    return F.when(written | (F.size(terms) < 2), query).otherwise(F.array_join(F.transform(terms, lambda t: F.concat(F.lit("all:"), t)), " AND "))


def plain_terms(c: Column) -> Column:
    """A Boolean query as its distinct words (whatever their case), in order; a plain one is unchanged."""
    pieces = _pieces(F.translate(c, "()", "  "))
    split = F.transform(pieces, lambda p: F.when(_is_phrase(p), F.split(F.btrim(F.btrim(p, F.lit('"'))), r"\s+")).when(p.isin("AND", "OR", "NOT"), F.array().cast("array<string>")).otherwise(F.array(F.btrim(p, F.lit('"')))))
    words = F.filter(F.flatten(split), lambda w: w != "")
    low = F.transform(words, F.lower)
    first = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    boolean = c.rlike(r'["()]') | F.exists(pieces, lambda p: p.isin("AND", "OR", "NOT"))
    return F.when(boolean, F.array_join(first, " ")).otherwise(c)


def block_query(blocks: Column) -> Column:
    """Each block's synonyms (an array of arrays) joined by OR over all field codes, blocks joined by
    AND; blank synonyms and empty blocks go."""
    clean = F.transform(blocks, lambda b: F.filter(F.transform(b, lambda t: F.trim(F.translate(t, '"\u201c\u201d', ""))), lambda t: t != ""))
    coded = lambda t: F.array(*[F.concat(F.lit(f'{code}="'), t, F.lit('"')) for code in FIELD_CODES])
    made = F.transform(F.filter(clean, lambda b: F.size(b) > 0), lambda b: F.concat(F.lit("("), F.array_join(F.flatten(F.transform(b, coded)), " OR "), F.lit(")")))
    return F.array_join(made, " AND ")


def category_query(c: Column, categories: list[str], low: str | None = None, high: str | None = None, today: str = "") -> Column:
    """Required terms within categories and, if given, submission dates (ISO, either end)."""
    listed = " OR ".join(f"cat:{x}" for x in categories)
    dates = f" AND submittedDate:[{(low or '1991-01-01').replace('-', '')}0000 TO {(high or today).replace('-', '')}2359]" if low or high else ""
    return F.concat(F.lit("("), required_terms(c), F.lit(f") AND ({listed}){dates}"))
