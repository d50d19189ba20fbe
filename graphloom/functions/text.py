"""Text functions of the extraction and search paths as Column expressions.

White space is Unicode white space everywhere, as in the browser languages from
which the record format comes; lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record format.
FIELD, RECORD, DONE, JOIN = "<|>", "##", "<|COMPLETE|>", " <SEP> "
#: One white-space character, and one CJK ideograph.
SPACE = r"[\s\x0B\p{Z}\x{FEFF}]"
#: All white-space characters.
SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = "[一-鿿]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at either end. White space before a closing NEL, which
    is none itself, goes too: the pattern's end of a line is before it."""
    text = _col(c)
    return F.when(F.endswith(text, F.lit("\x85")), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(F.btrim(text, F.lit(SPACES)))


def collapsed(c: Column | str) -> Column:
    """Trimmed, and each run of white space one space."""
    return trimmed(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def clean_str(c: Column | str) -> Column:
    """A field of a record: character references resolved, quotes, control
    characters and angle brackets removed, trimmed before the brackets go.
    One look tells whether there is any of that; most fields have none."""
    text = resolved = _col(c)
    for name, value in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        resolved = F.replace(resolved, F.lit(name), F.lit(value))
    out = F.when(F.contains(text, F.lit("&")), resolved).otherwise(text)
    out = F.btrim(F.regexp_replace(out, r'["\x00-\x1f\x7f-\x9f]', ""), F.lit(SPACES))
    unclean = text.rlike(r'[&"<>\x00-\x1f\x7f-\x9f]')
    return F.when(unclean, F.regexp_replace(out, "[<>]", "")).otherwise(F.btrim(text, F.lit(SPACES)))


def split_markers(c: Column | str, *markers: str) -> Column:
    """Split at any of the literal markers; blank parts are dropped. Without
    markers: the whole text."""
    if not markers:
        return F.array(_col(c))
    pattern = "|".join("".join("\\" + x if not x.isalnum() else x for x in m) for m in markers)
    return F.filter(F.transform(F.split(_col(c), pattern, -1), trimmed), lambda x: x != "")


def records(c: Column | str) -> Column:
    """The records of a reply: trimmed, non-empty, without any that holds the
    end mark."""
    return F.filter(F.transform(F.split(_col(c), RECORD, -1), trimmed), lambda x: (x != "") & ~F.contains(x, F.lit(DONE)))


def unwrapped(c: Column | str) -> Column:
    """What stands between the first ``(`` and the last ``)`` of a line, else
    the empty text."""
    return F.regexp_extract(_col(c), r"\((.*)\)", 1)


def fields(c: Column | str) -> Column:
    return F.split(_col(c), r"<\|>", -1)


def parse_float(c: Column | str) -> Column:
    """The longest number at the start; null if there is none."""
    return F.regexp_extract(_col(c), rf"^{SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def normalized(c: Column | str) -> Column:
    """Lower case; anything but CJK, ASCII word characters and white space
    becomes a space; collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^一-鿿A-Za-z0-9_\s]", " "), r"\s+", " "))


def grams(c: Column | str, n: int) -> Column:
    """Sliding n-grams of a normalised text whose ends are not spaces.

    One pattern that looks ahead from every character, in time linear in the
    text.
    """
    # A search goes on by half a surrogate pair, where no character begins.
    first = r"[^ \x{DC00}-\x{DFFF}]"
    gram = first if n == 1 else rf"{first}.{{{n - 2}}}[^ ]"
    return F.regexp_extract_all(_col(c), F.lit(rf"(?s)(?=({gram}))"), F.lit(1))


def keywords(c: Column | str) -> Column:
    """Distinct words of two characters or more, and every CJK character."""
    text = _col(c)
    words = F.filter(F.split(text, r"\s+", -1), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(CJK), F.lit(0))))


def characters(c: Column | str) -> Column:
    """The set of a text's characters."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), "", -1), lambda x: x != ""))


def jaccard_chars(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two sets of characters."""
    x, y = characters(a), characters(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def similar_names(a: Column | str, b: Column | str) -> Column:
    """Whether two names may be one: few edits for their length, or about the
    same characters. Edits are counted only where the lengths allow few enough."""
    a, b = _col(a), _col(b)
    la, lb = F.length(a), F.length(b)
    most = F.floor(F.least(la, lb) / 2).cast("int")
    edits = F.when(F.abs(la - lb) <= most, F.levenshtein(F.lower(a), F.lower(b)) <= most).otherwise(F.lit(False))
    j = jaccard_chars(a, b)
    return edits | F.when(F.greatest(la, lb) < 4, j > 0.6).otherwise(j >= 0.8)


def character_mask(c: Column | str) -> Column:
    """The set of a text's characters as bits of a number; characters may share
    a bit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)).cast("int"))
    return F.aggregate(characters(c), F.lit(0).cast("long"), lambda mask, x: mask.bitwiseOR(bit(x)))


def bag_masks(c: Column | str) -> tuple[Column, Column]:
    """A text's characters with their counts as bits of two numbers: a bit for a
    character's first occurrence, one for its second, and so on. Letters that
    stand together in an alphabet get bits of their own for the first three."""
    low = F.lower(_col(c))
    every = F.filter(F.split(low, "", -1), lambda x: x != "")
    often = lambda x: F.length(low) - F.length(F.replace(low, x, F.lit("")))
    nth = lambda x: F.transform(F.sequence(F.lit(1), often(x)), lambda n: F.pmod(F.ascii(x) - 97 + 37 * (n - 1), F.lit(128)).cast("int"))
    places = F.flatten(F.transform(F.array_distinct(every), nth))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
    word = lambda low: F.aggregate(places, F.lit(0).cast("long"), lambda mask, p: F.when((p >= low) & (p < low + 64), mask.bitwiseOR(bit(p - low))).otherwise(mask))
    return word(0), word(64)


def _only(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(F.bitwise_not(b))).cast("int")


def may_have_few_edits(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A cheap test that holds wherever edits are few enough for
    ``similar_names``. Both names come with their ``length``, ``bag_a`` and
    ``bag_b``: a bit that only one has is a character that the other lacks at
    least once, which costs an edit."""
    most = F.floor(F.least(a["length"], b["length"]) / 2)
    lacks = lambda x, y: _only(x["bag_a"], y["bag_a"]) + _only(x["bag_b"], y["bag_b"])
    return (F.abs(a["length"] - b["length"]) <= most) & (F.greatest(lacks(a, b), lacks(b, a)) <= most)


def may_share_characters(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A cheap test that holds wherever sets of characters are as alike as
    ``similar_names`` asks for. Both names come with their ``length``, number of
    different characters ``size`` and ``mask``."""
    both, apart = a["size"] + b["size"], _only(a["mask"], b["mask"]) + _only(b["mask"], a["mask"])
    # (both - apart) / (both + apart) is at least as large as the similarity.
    return F.when(F.greatest(a["length"], b["length"]) < 4, 4 * apart < both).otherwise(9 * apart <= both)


def may_be_similar(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A cheap test that holds for all pairs that ``similar_names`` holds for.
    Both names come with their ``length``, number of different characters
    ``size`` and ``mask``: a bit that only one mask has stands for a character
    that only that name has, which costs an edit and lowers the similarity."""
    most = F.floor(F.least(a["length"], b["length"]) / 2)
    edits = (F.greatest(_only(a["mask"], b["mask"]), _only(b["mask"], a["mask"])) <= most) & (F.abs(a["length"] - b["length"]) <= most)
    return edits | may_share_characters(a, b)


def xorshift32(state: Column | str) -> Column:
    """The next state of the generator with shifts 13, 17 and 5, from 0 to
    2**32 - 1; over 2**32 it is a number from 0 to less than 1."""
    x = _col(state).cast("long")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    x = low(x)
    x = low(x.bitwiseXOR(F.shiftleft(x, 13)))
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return low(x.bitwiseXOR(F.shiftleft(x, 5)))


def fuzzy_similarity(a: Column | str, b: Column | str) -> Column:
    """One minus edits over the longer length; null for two empty texts."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest)


def decisions(c: Column | str, pairs: Column | int) -> Column:
    """The numbers (from 1) that a reply answers with yes, up to ``pairs``."""
    limit = F.lit(pairs) if isinstance(pairs, int) else pairs
    parsed = F.transform(
        F.split(_col(c), RECORD, -1),
        lambda r: F.when(F.lower(F.regexp_extract(r, r"<\|>([a-zA-Z]+)<\|>", 1)) == "yes", F.regexp_extract(r, r"<\|>(\d+)<\|>", 1).try_cast("int")),
    )
    return F.filter(parsed, lambda i: i.isNotNull() & (i >= 1) & (i <= limit))


def answer_text(c: Column | str) -> Column:
    """An answer without its closing list of entities."""
    text = _col(c)
    head = F.regexp_extract(text, r"(?s)\A(.*)\[.*\]", 1)
    return trimmed(F.when(text.rlike(r"(?s)\[.*\]"), head).otherwise(text))


def answer_entities(c: Column | str) -> Column:
    """The first list of strings in an answer; empty if it can't be read."""
    found = F.from_json(F.regexp_extract(_col(c), r'(?s)(\[".*?"\])', 1), "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


REPORT = "struct<title:string,summary:string,rating:double,rating_explanation:string,findings:array<struct<summary:string,explanation:string>>>"


def json_of_reply(c: Column | str) -> Column:
    """The JSON object in a reply: cut from the first brace to the last, which
    leaves out fences around it, commas before a closing bracket removed."""
    out = F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(out, r",(\s*[}\]])", "$1")


def report(c: Column | str) -> Column:
    """A report from a reply; null if it lacks a part or its rating is not
    within 0 and 10."""
    r = F.from_json(json_of_reply(c), REPORT)
    there = lambda x: x.isNotNull() & (F.length(x) > 0)
    valid = (
        there(r["title"]) & there(r["summary"]) & there(r["rating_explanation"]) & r["rating"].between(0, 10)
        & (F.size(r["findings"]) >= 1) & F.forall(r["findings"], lambda f: there(f["summary"]) & there(f["explanation"]))
    )
    return F.when(F.coalesce(valid, F.lit(False)), r)


def report_markdown(r: Column | str) -> Column:
    """A report as text."""
    r = _col(r)
    parts = F.concat(F.array(F.concat(F.lit("# "), r["title"]), r["summary"]), F.transform(r["findings"], lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), f["explanation"])))
    return F.array_join(parts, "\n\n")


def csv_escaped(c: Column | str) -> Column:
    """For a quoted CSV field: quotes doubled, line ends as spaces, null empty."""
    return F.regexp_replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit('"'), F.lit('""')), r"\r?\n", " ")


def substring_hit(text: Column | str, query: str) -> Column:
    """Whether any word of the query longer than two characters is in the text."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    low = F.lower(_col(text))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    return hit
