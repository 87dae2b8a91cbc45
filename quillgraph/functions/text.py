"""Column functions on text: tokens, names, markers, hashes. All stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that names are compared without.
NAME_PUNCTUATION = "（）()。，,、．. 　\t\r\n·:：“”\"'-—_/\\《》「」！!？?…"
#: Phrases of an answer that declines.
REFUSAL_MARKERS = (
    "资料中未提及", "未提及", "无法确定", "没有提及", "未找到", "资料中没有", "无法回答", "缺少", "未披露", "不足以", "没有关于", "没有记载", "未记载", "未涉及", "没有相关",
)


def _runs(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def tokens(c: Column) -> Column:
    """Overlapping pairs of CJK characters (a lone one stays), then lower-case ASCII words, then numbers; repeats kept."""
    pairs = F.transform(
        _runs(c, "[一-鿿]+"),
        lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        ),
    )
    words = F.transform(_runs(c, "[A-Za-z]+"), F.lower)
    return F.concat(F.flatten(pairs), words, _runs(c, r"[0-9]+(?:\.[0-9]+)?"))


def normal_name(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), NAME_PUNCTUATION, "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s　]+", "")


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"doc-[0-9]{4,8}|\[[0-9]{1,2}\]", "")


def script(c: Column) -> Column:
    """cjk, ascii (also without any letter) or mixed."""
    han, latin = c.rlike("[一-鿿]"), c.rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "cjk").otherwise("ascii")


def discriminator(c: Column) -> Column:
    """The 1 to 3 digits in brackets at the end of a name, or ''."""
    found = F.regexp_extract(c, "[（(]([0-9０-９]{1,3})[）)]", 1)
    return F.translate(found, "０１２３４５６７８９", "0123456789")


def lexical_verdict(a: Column, b: Column) -> Column:
    """strong: one name; weak: perhaps one name; incompatible: not."""
    x, y = normal_name(a), normal_name(b)
    return (
        F.when(discriminator(a) != discriminator(b), "incompatible")
        .when((x == "") | (y == ""), "incompatible")
        .when(x == y, "strong")
        .when(script(a) != script(b), "incompatible")
        .when(F.substring(x, 1, 2) != F.substring(y, 1, 2), "incompatible")
        .otherwise("weak")
    )


def assigned_split(question: Column) -> Column:
    """train, dev or test by a hash of the question: 40, 20 and 40 per cent."""
    share = F.conv(F.substring(F.sha2(question, 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return F.when(share < F.lit(0.4), "train").when(share < F.lit(0.4 + 0.2), "dev").otherwise("test")


def windows(c: Column, n: int) -> Column:
    """All windows of n characters; a shorter text is its own window."""
    return F.when(F.length(c) <= n, F.array(c)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    )


def hash_bucket(c: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % dim).cast("int")


def refuses(c: Column) -> Column:
    """Whether a marker stands in the first 160 characters of an answer."""
    start = F.substring(F.coalesce(c, F.lit("")), 1, 160)
    return start.rlike("|".join(REFUSAL_MARKERS))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def idf(n: Column, df: Column) -> Column:
    half = F.lit(0.5)
    return F.when(df == 0, F.lit(0.0)).otherwise(F.greatest(F.log(F.lit(1.0) + (n - df + half) / (df + half)), F.lit(0.000001).cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, accumulated as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Relations whose ends may change places.
SYMMETRIC = ("SPOUSE_OF", "FRIEND_OF")


def literal_key(c: Column) -> Column:
    """A literal end in normal form behind its mark; other ends as they are."""
    return F.when(c.startswith("lit:"), F.concat(F.lit("lit:"), normal_name(F.substring(c, F.lit(5), F.length(c))))).otherwise(c)


def edge_key(src: Column, rel: Column, dst: Column) -> Column:
    """src, rel and dst as one comparable struct: literals in normal form, ends of symmetric relations in order."""
    a, b = literal_key(src), literal_key(dst)
    swap = rel.isin(*SYMMETRIC) & (a > b)
    return F.struct(F.when(swap, b).otherwise(a).alias("src"), rel.alias("rel"), F.when(swap, a).otherwise(b).alias("dst"))


def salvaged_json(c: Column) -> Column:
    """The JSON inside an answer: a fenced block, else from the first { to the last }; null if it doesn't parse."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    body = F.when(F.trim(fenced) != "", F.trim(fenced)).otherwise(braces)
    return F.when(F.get_json_object(body, "$").isNotNull(), body)


def document_ids(c: Column) -> Column:
    """The document ids that a text names, in order, each once."""
    return F.array_distinct(_runs(c, "doc-[0-9]{4,8}"))


def rendered(template: str, **values: Column) -> Column:
    """A template with {names} filled in; a name without a value is an error, {{ and }} are braces."""
    out = F.lit("")
    for literal, name, _, _ in string.Formatter().parse(template):
        out = F.concat(out, F.lit(literal))
        if name is not None:
            if name not in values:
                raise KeyError(f"template lacks a value for {name!r}")
            out = F.concat(out, F.coalesce(values[name].cast("string"), F.lit("")))
    return out


def judged(c: Column) -> Column:
    """A judge's verdict: the JSON field, else the word true or false behind it; null if there is neither."""
    field = F.get_json_object(salvaged_json(c), "$.correct")
    loose = F.regexp_extract(F.lower(c), r"\"?correct\"?\s*[:：]\s*\"?(true|false)", 1)
    return F.when(F.lower(field).isin("true", "false"), F.lower(field) == "true").when(loose != "", loose == "true")


def token_cost(inputs: Column, outputs: Column, price_in: Column, price_out: Column, cached: Column) -> Column:
    """Cost of tokens at prices per million; what came from the cache is free."""
    return F.when(F.coalesce(cached, F.lit(False)), F.lit(0.0)).otherwise((F.coalesce(inputs, F.lit(0)) * price_in + F.coalesce(outputs, F.lit(0)) * price_out) / F.lit(1e6))


def percent(c: Column) -> Column:
    """A share as a text with one decimal; a dash where there is none."""
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(F.format_string("%.1f%%", c * 100.0))


def compact_json(*columns: str) -> Column:
    """Columns as one line of JSON without spaces, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


#: What a question may begin with before its content.
ASKING = "^(哪只狼|哪只羊|哪个机器人|哪位角色|谁)"


def four_grams(c: Column) -> Column:
    """The distinct four-character windows of a question without its question words."""
    t = F.regexp_replace(F.regexp_replace(c, ASKING, ""), "？$", "")
    return F.when(F.length(t) >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 3, F.lit(1))), lambda i: F.substring(t, i, F.lit(4))))).otherwise(F.array().cast("array<string>"))
