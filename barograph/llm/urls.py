"""URL filter: domain rules, then a weighted vocabulary counted by one Aho-Corasick pass.

A strict term rejects on one hit, soft terms reject when several distinct ones hit and their weights reach a limit. A hit counts
only between boundaries: neither neighbour may be a letter or digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C

#: Terms of which one hit rejects, and terms with weights. Parameters: vocabulary() reads others from a table.
STRICT_TERMS = (
    "adult-x", "bestiality", "camgirl", "camgirls", "casino", "cheap-pills", "cialis", "escort", "escorts", "hentai", "keygen", "milf", "nsfw", "onlinecasino", "payday-loan", "porn", "porno", "pornstar", "sexcam",
    "slots", "spam-farm", "torrent", "torrents", "viagra", "warez", "webcam-sex", "xnxx", "xvideos", "xxx",
)
SOFT_TERMS = {
    "ads": 1.0, "adult": 1.0, "affiliate": 0.5, "bets": 1.0, "betting": 1.0, "bonus": 1.0, "buy": 0.5, "cheap": 1.0, "click": 0.5, "coupon": 0.5, "crack": 1.0, "dating": 1.0, "deal": 0.5, "deals": 0.5, "discount": 0.5, "erotic": 1.5, "farm": 1.0, "free": 1.0,
    "gambling": 1.5, "hack": 0.5, "jackpot": 1.5, "loan": 1.0, "loans": 1.0, "lottery": 1.0, "nude": 1.5, "offer": 0.5, "pills": 1.0, "poker": 1.0, "prize": 1.0, "promo": 0.5, "sex": 1.5, "sexy": 1.5, "spam": 1.0, "sweepstakes": 1.0, "track": 1.0, "win": 1.0,
}
#: Distinct soft terms, and their weights' sum, that reject.
SOFT_LIMIT, SOFT_WEIGHT = 2, 2.0
#: (host suffix and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a rule fits its host and all subdomains, and paths that begin with its own."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def vocabulary(table: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict, soft) terms of a table (term, weight, strict): lower-cased, trimmed, without empty ones; of a repeated term the
    greatest weight counts, and strict before soft. At most `most` rows, as the terms go to every task."""
    rows = table.select(F.lower(F.trim("term")).alias("term"), F.col("weight").cast("double"), F.col("strict").cast("boolean")).where("term <> ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms")
    strict = tuple(sorted({r["term"] for r in rows if r["strict"]}))
    soft: dict[str, float] = {}
    for r in rows:
        if not r["strict"] and r["term"] not in strict:
            soft[r["term"]] = max(soft.get(r["term"], 0.0), 1.0 if r["weight"] is None else r["weight"])
    return strict, soft


def decoded(text: str) -> str:
    """Percent escapes read as UTF-8, once; as it is where they hold something else."""
    if "%" not in text:
        return text
    try:
        return unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        return text


def term_hits(column: str, df: DataFrame, strict: tuple[str, ...], soft: dict[str, float]) -> DataFrame:
    """Adds strict_hits (hits of strict terms), soft_terms (distinct soft terms hit) and soft_weight (the sum of their weights)
    for a string column, read with its percent escapes decoded and in lower case."""
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", strict_hits int, soft_terms int, soft_weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for terms, is_strict in ((soft, False), (strict, True)):
            for term in terms:
                found.add_word(term, (term, len(term), is_strict))
        if len(found):
            found.make_automaton()
        seen: dict[str, tuple[int, int, float]] = {}
        for batch in batches:
            counts = []
            for text in batch.column(column).to_pylist():
                text = decoded(text or "").lower()
                got = seen.get(text)
                if got is None:
                    hard, mild = 0, set()
                    for last, (term, size, is_strict) in found.iter(text) if len(found) else ():
                        begin = last - size
                        if (begin >= 0 and text[begin].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                            continue
                        if is_strict:
                            hard += 1
                        else:
                            mild.add(term)
                    got = (hard, len(mild), sum(soft[t] for t in sorted(mild)))
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen[text] = got
                counts.append(got)
            hard, mild, weight = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hard, pa.int32()), pa.array(mild, pa.int32()), pa.array(weight, pa.float64())], [*columns, "strict_hits", "soft_terms", "soft_weight"])

    return df.mapInArrow(C.tidy(run), schema)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT_TERMS, soft: dict[str, float] | None = None, soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """(page_id, url, host, path, strict_hits, soft_terms, soft_weight, rule, verdict) for every page.

    A url that is null or has no `://` has an empty host and path and no rule; its verdict is the vocabulary's over the whole
    string (allow for null). Repeated rows and null ids are kept as they are; other columns of pages are not used.
    """
    x = pages.select("page_id", F.col("url").cast("string").alias("url"))
    x = x.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    x = term_hits("url", x, strict, SOFT_TERMS if soft is None else soft)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    several = (F.col("soft_terms") >= soft_limit) & (F.col("soft_weight") >= soft_weight)
    return x.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when((F.col("strict_hits") > 0) | several, "block").otherwise("allow"))})


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _bounded(term: str) -> str:
    return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"


OP3_SQL = f"""
with r as (select page_id, lower(coalesce(try(url_decode(url)), url, '')) as u, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
h as (select page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
v as (select *, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
   when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
   when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
   when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
   ({" or ".join(map(_bounded, STRICT_TERMS))}) as strict, ({" + ".join(f"({_bounded(t)})::int" for t in SOFT_TERMS)}) as soft, ({" + ".join(f"({_bounded(t)})::int * {w}::double" for t, w in SOFT_TERMS.items())}) as weight from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when strict or (soft >= {SOFT_LIMIT} and weight >= {SOFT_WEIGHT}) then 'block' else 'allow' end as verdict from v
"""
