"""Column functions on texts and tokens; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LETTERS = r"(\p{L}+)"
FOLD_FROM = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿæœß"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaos"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
DELIMITERS = (". ", "! ", "? ", ".\n", "!\n", "?\n")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))


def words(text: Column, lower: bool = True) -> Column:
    """Runs of letters or digits, lower case or as they are."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def strip_numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.rlike(r"^\p{N}+$"))


def min_length(tokens: Column, n: int = 2) -> Column:
    return F.filter(tokens, lambda w: F.length(w) >= n)


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens that aren't in a short list of stop words."""
    listed = F.array(*map(F.lit, stop)) if stop else F.expr("array()").cast("array<string>")
    return F.filter(tokens, lambda w: ~F.array_contains(listed, w))


def keep_only(tokens: Column, listed: list[str]) -> Column:
    """Tokens of a short keep list, as for texts read by OCR."""
    return F.filter(tokens, lambda w: w.isin(listed))


def mapped(tokens: Column, mapping: dict[str, str]) -> Column:
    """Tokens replaced by a short dictionary, as for lemmas or modern spellings; others stay."""
    if not mapping:
        return tokens
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))


def ascii_fold(text: Column) -> Column:
    """Lower-case Latin letters without their accents."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def stem(token: Column) -> Column:
    """A small English suffix stripper; a full stemmer can be plugged in as a pandas function instead."""
    return F.regexp_replace(token, r"(ations|ation|ings|ing|edly|ed|ly|ies|es|s)$", "")


def ngrams(tokens: Column, n: int = 3) -> Column:
    """Contiguous runs of n tokens, joined by an underscore."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), "_"))).otherwise(F.expr("array()").cast("array<string>"))


def gap_ngrams(tokens: Column, n: int, gap: int) -> Column:
    """n-grams whose first token begins a window of n + gap tokens and whose others follow in order within it."""

    def extend(parts: Column, left: int) -> Column:
        if not left:
            return F.transform(parts, lambda p: p["t"])
        more = F.flatten(F.transform(parts, lambda p: F.transform(F.when(p["i"] + 1 <= p["z"], F.sequence(p["i"] + 1, p["z"])).otherwise(F.expr("array()").cast("array<int>")), lambda j: F.struct(F.concat(p["t"], F.lit("_"), F.element_at(tokens, j)).alias("t"), j.alias("i"), p["z"].alias("z")))))
        return extend(more, left - 1)

    size = F.size(tokens)
    begin = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.element_at(tokens, i).alias("t"), i.alias("i"), F.least(size, i + (n + gap - 1)).alias("z")))
    return F.when(size >= n, extend(begin, n - 1)).otherwise(F.expr("array()").cast("array<string>"))


def word_order_free(ngram: Column) -> Column:
    """An n-gram with its words in alphabetical order."""
    return F.array_join(F.sort_array(F.split(ngram, "_")), "_")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def unescape(text: Column) -> Column:
    """The common character references decoded, the ampersand's last."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeeze(text: Column) -> Column:
    """Line breaks, tabs and runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def clean(html: Column) -> Column:
    return squeeze(unescape(strip_tags(html)))


def formula_text(text: Column) -> Column:
    """Text as phrases are compared: lower case, without punctuation, symbols and digits, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[\p{P}\p{S}\p{N}]+", ""), r"\p{Z}+", " "))


def trim_before(context: Column) -> Column:
    """Context before a passage without its first, partial word."""
    return F.regexp_replace(context, r"^[^ ]+ ", "")


def trim_after(context: Column) -> Column:
    """Context after a passage without its last, partial word."""
    return F.regexp_replace(context, r" [^ ]+$", "")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text's UTF-8; a start below 0 counts as 0; broken characters at the edges are left out."""
    first = F.greatest(start, F.lit(0))
    part = F.substring(F.encode(text, "utf-8"), first + 1, F.greatest(end - first, F.lit(0)))
    return F.replace(F.make_valid_utf8(part.cast("string")), F.lit("\ufffd"), F.lit(""))


def relative_position(byte: Column, start: Column, end: Column) -> Column:
    """Where a byte lies in its document, in percent, to two places."""
    return F.round(byte * F.lit(100.0) / F.nullif(end - start, F.lit(0)), 2)


def passage_length(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def year(text: Column) -> Column:
    """The first run of digits, negative where the text begins with a minus and digits; null without digits."""
    return F.expr("1") * F.when(text.rlike(r"^-\d+"), -1).otherwise(1) * F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def escape_html(text: Column) -> Column:
    """A text as it is stored: control characters gone, angle brackets escaped."""
    return F.replace(F.replace(F.regexp_replace(text, r"[\x00-\x1f]", ""), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_label(label: Column, n: int = 20) -> Column:
    """A node's label, cut at its second comma or after n characters."""
    return F.when(F.length(label) - F.length(F.replace(label, F.lit(","), F.lit(""))) >= 2, F.substring_index(label, ",", 2)).when(F.length(label) > n, F.concat(F.substring(label, 1, n), F.lit("..."))).otherwise(label)


def short_title(title: Column, n: int = 300) -> Column:
    """A title of a group, cut at the last whole word within n characters."""
    return F.when(F.length(title) > n, F.concat(F.regexp_replace(F.substring(title, 1, n), r" [^ ]*$", ""), F.lit(" [...]"))).otherwise(title)


def truncate_passage(text: Column, limit: int = 600) -> Column:
    """Text up to its last sentence end beyond half the limit (delimiters in order of preference), else the last word."""
    head = F.substring(text, 1, limit)
    out = F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("..."))
    for mark in reversed(DELIMITERS):
        last = F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 2
        found = (F.locate(mark[::-1], F.reverse(head)) > 0) & (last - 1 > limit / 2)
        out = F.when(found, F.substring(head, F.lit(1), last)).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def fit_prompt(a: Column, b: Column, context: int) -> tuple[Column, Column]:
    """Two passages, both cut to half of what a prompt may hold if they are too long together."""
    most = context * 4 // 3
    over = F.length(a) + F.length(b) > most
    cut = lambda x: F.when(over & (F.length(x) > most // 2), F.concat(F.substring(x, 1, most // 2), F.lit("..."))).otherwise(x)
    return cut(a), cut(b)


def highlight(own: Column, other: Column, dropped: Column | None = None) -> Column:
    """Tokens of a passage as text, those that the other passage has marked as matches, dropped ones as filtered."""
    shown = F.transform(own, lambda t: F.when(F.array_contains(other, t), F.concat(F.lit('<span class="token-match">'), t, F.lit("</span>"))).when(F.array_contains(dropped, t) if dropped is not None else F.lit(False), F.concat(F.lit('<span class="filtered-token">'), t, F.lit("</span>"))).otherwise(t))
    return F.array_join(shown, " ")


def word_match(field: Column, query: str) -> Column:
    """A search in a text field: words that must all occur, NOT word, OR word, "" for empty, "exact value" in quotes.

    Words are whole and in either case. OR joins a word with the term before it.
    """
    import re

    terms: list[Column] = []
    for quoted, said, word in re.findall(r'"([^"]*)"|(NOT |OR )?(\w+)', query):
        if not word:
            terms.append(field == quoted)
            continue
        here = field.rlike(rf"(?iuU)\b{word}\b")
        if said == "NOT ":
            terms.append(~here)
        elif said == "OR " and terms:
            terms[-1] = terms[-1] | here
        else:
            terms.append(here)
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def number_match(field: Column, query: str) -> Column:
    """A search in a number field: a value, or a range a-b, a- or -b; a negative number is written in parentheses."""
    import re

    m = re.fullmatch(r"\s*(?:(\d+(?:\.\d+)?|\(-\d+(?:\.\d+)?\)))?\s*(-)?\s*(?:(\d+(?:\.\d+)?|\(-\d+(?:\.\d+)?\)))?\s*", query)
    if not m:
        return F.lit(True)
    low, dash, high = (float(x.strip("()")) if x and x != "-" else x for x in m.groups())
    if not dash:
        return field == F.lit(low) if low is not None else F.lit(True)
    if low is None and high is None:
        return F.lit(True)
    if low is None:
        return field <= high
    return field >= low if high is None else field.between(low, high)
