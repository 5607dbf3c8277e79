"""Column functions for list cells, tag strings, product text, prompts and model replies.

All of them are compositions of built-in Spark functions, so they stay inside the JVM and fuse with the
surrounding plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and the reply key names that existing files and model replies use.
TAG_SEPARATOR = "; "
TEXT_SEPARATOR = " | "
REPLY_KEYS = ("теги", "tags")
MAX_CHARS_PER_CHUNK = 600000
# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    Without it every mention would repeat the whole expression, parsing included.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind (plain ``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def not_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(not_blank(c), strip(c))


def _bracketed(c: Column) -> Column:
    return c.startswith("[") & c.endswith("]")


def parse_list(c: Column | str) -> Column:
    """List cell -> ``array<string>``: a JSON or Python-style list, else the cell itself as the only item.

    Null gives an empty list. A list holding a bare ``null`` is not a list literal and falls back as well.
    """
    cell = _col(c).cast("string")

    def choose(parsed: Column) -> Column:
        usable = parsed.isNotNull() & ~F.exists(parsed, lambda x: x.isNull())
        return F.when(usable, parsed).otherwise(F.array(cell))

    empty = F.array().cast("array<string>")
    # Most cells are plain text: only those with a bracket up front are parsed at all.
    listed = cell.rlike(r"(?U)^\s*\[")
    return F.when(cell.isNull(), empty).when(listed, let(_json_list(cell, single_quotes=True), choose)).otherwise(
        F.array(cell)
    )


def parse_reviews_json(c: Column | str) -> Column:
    """Strict JSON list cell -> stripped, non-blank items; anything else is one item."""
    cell = _col(c).cast("string")
    items = F.coalesce(_json_list(cell), F.array(cell))
    return F.when(cell.isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(items, not_blank), strip)
    )


def parse_tags(c: Column | str, lower: bool = False) -> Column:
    """``"a; b;"`` -> ``["a", "b"]``; null gives an empty list."""
    parts = F.transform(F.split(_col(c), ";"), strip)
    if lower:
        parts = F.transform(parts, F.lower)
    kept = F.filter(parts, lambda t: t != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def dedupe_ignoring_case(c: Column | str) -> Column:
    """Stripped tags of an array without repeats regardless of case; the first spelling stays in its place."""
    kept = F.transform(F.filter(_col(c), not_blank), strip)

    def first_only(tags: Column) -> Column:
        return let(
            F.transform(tags, F.lower),
            lambda low: F.filter(tags, lambda t, i: F.array_position(low, F.lower(t)) == i + 1),
        )

    return let(kept, first_only)


def join_tags(c: Column | str) -> Column:
    return F.array_join(_col(c), TAG_SEPARATOR)


def join_comments(comments: Column | str) -> Column:
    """Non-blank comments, unstripped, joined by one blank."""
    return F.array_join(F.filter(_col(comments), not_blank), " ")


def build_text(
    name: Column | str, good_type: Column | str, good_subtype: Column | str, comments: Column | str
) -> Column:
    """``name | type | subtype | comments`` with blank attributes left out.

    A non-empty list of blank comments still adds an empty last section.
    """
    comments = _col(comments)
    return F.concat_ws(
        TEXT_SEPARATOR,
        blank_to_null(name),
        blank_to_null(good_type),
        blank_to_null(good_subtype),
        F.when(F.size(comments) > 0, join_comments(comments)),
    )


def chunk_reviews(reviews: Column | str, max_chars: int = MAX_CHARS_PER_CHUNK) -> Column:
    """Pack reviews in order into chunks of at most ``max_chars``; a longer review is alone in its chunk.

    The fold carries only the chunk start positions, so no text is copied until the final slices.
    """
    reviews = _col(reviews)
    sized = F.transform(
        reviews,
        lambda x, i: F.struct(i.alias("i"), F.coalesce(F.length(x), F.lit(0)).cast("long").alias("n")),
    )
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, item: Column) -> Column:
        opens = (item["i"] == 0) | (acc["used"] + item["n"] > max_chars)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(item["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, item["n"]).otherwise(acc["used"] + item["n"]).alias("used"),
        )

    starts = F.aggregate(sized, start, step, lambda acc: acc["starts"])
    return F.transform(
        starts,
        lambda s, k: F.slice(reviews, s + 1, F.coalesce(F.get(starts, k + 1), F.size(reviews)) - s),
    )


def extract_json(reply: Column | str) -> Column:
    """JSON text of a reply: the last fenced block if there is one, else the widest ``{...}``, else null."""
    reply = _col(reply)
    fenced = F.try_element_at(
        F.regexp_extract_all(reply, F.lit(r"(?is)```json\s*(.*?)\s*```"), F.lit(1)), F.lit(-1)
    )
    return F.coalesce(fenced, _widest_braces(reply))


def _widest_braces(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def _whole_json(text: Column, single_quotes: bool = False) -> Column:
    """The text if it is one complete JSON value, else null.

    ``from_json`` ignores what follows a value; inside brackets it has to be a separate item or an error.
    """
    options = {"allowSingleQuotes": str(single_quotes).lower()}
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options)
    return let(items, lambda xs: F.when(F.size(xs) == 1, F.get(xs, 0)))


def _json_object(c: Column) -> Column:
    """Object text -> map of raw JSON values, null when the text is not one valid object."""

    def read(text: Column) -> Column:
        whole = F.when(text.startswith("{") & text.endswith("}"), _whole_json(text))
        return F.from_json(whole, "map<string,string>")

    return let(strip(c), read)


def _json_list(c: Column, single_quotes: bool = False) -> Column:
    def read(text: Column) -> Column:
        return F.from_json(F.when(_bracketed(text), _whole_json(text, single_quotes)), "array<string>")

    return let(strip(c), read)


def parse_tag_reply(reply: Column | str) -> Column:
    """Tagging reply -> ``array<string>`` of stripped tags (empty when nothing usable is found)."""
    local, english = REPLY_KEYS

    def read(fields: Column) -> Column:
        raw = F.when(F.map_contains_key(fields, local), fields[local]).otherwise(fields[english])
        return F.transform(F.filter(_json_list(raw), not_blank), strip)

    tags = let(_json_object(extract_json(reply)), read)
    return F.coalesce(tags, F.array().cast("array<string>"))


def parse_rerank_reply(reply: Column | str, candidates: Column | str, max_return: Column | int = 5) -> Column:
    """Rerank reply -> ``array<struct<tag,score>>`` in reply order, restricted to the candidates.

    ``candidates`` is ``array<struct<tag string, score double>>``. An unreadable score becomes the
    candidate's own score; repeated tags stay; reading stops after ``max_return`` accepted items.
    """
    candidates = _col(candidates)

    def items_of(raw: Column) -> Column:
        whole = F.coalesce(_json_object(raw), _json_object(_widest_braces(raw)))
        return F.coalesce(_json_list(raw), let(whole, lambda fields: _json_list(fields["tags"])))

    def accept(m: Column) -> Column:
        tag = m["tag"]
        own = F.get(F.filter(candidates, lambda c: c["tag"] == tag), 0)
        return let(
            own,
            lambda known: F.when(
                known.isNotNull(),
                F.struct(tag.alias("tag"), F.coalesce(m["score"].try_cast("double"), known["score"]).alias("score")),
            ),
        )

    read = F.transform(let(strip(reply), items_of), lambda item: let(_json_object(item), accept))
    accepted = F.filter(read, lambda x: x.isNotNull())
    limit = max_return if isinstance(max_return, Column) else F.lit(max_return)
    return F.coalesce(
        F.slice(accepted, F.lit(1), limit), F.array().cast("array<struct<tag:string,score:double>>")
    )


def parse_pool_reply(reply: Column | str) -> Column:
    """Pool-filter reply -> ``struct<kept array<string>, rules array<struct<old_tag,new_tag,ord>>>``.

    Tags are stripped and lowercased; ``ord`` numbers the rules in reply order.
    """
    def clean(tags: Column) -> Column:
        return F.transform(F.filter(tags, not_blank), lambda t: F.lower(strip(t)))

    no_tags = F.array().cast("array<string>")
    no_rules = F.array().cast("array<struct<old_tag:string,new_tag:string,ord:int>>")

    def rules_of(fields: Column, position: Column) -> Column:
        new = F.coalesce(F.lower(strip(fields["new"])), F.lit(""))
        rules = F.transform(
            clean(_json_list(fields["old"])),
            lambda old: F.struct(old.alias("old_tag"), new.alias("new_tag"), position.alias("ord")),
        )
        return F.coalesce(rules, no_rules)

    def read(fields: Column) -> Column:
        # Items stay text until each is read on its own: one malformed rule does not void the others.
        items = F.coalesce(_json_list(fields["mappings"]), no_tags)
        rules = F.transform(items, lambda item, i: let(_json_object(item), lambda m: rules_of(m, i)))
        kept = F.coalesce(clean(_json_list(fields["kept_tags"])), no_tags)
        return F.struct(kept.alias("kept"), F.flatten(rules).alias("rules"))

    return let(_json_object(extract_json(reply)), read)


def parse_choice_reply(reply: Column | str) -> Column:
    """Cluster reply -> lowercased best tag, empty when the cluster has none."""
    fields = _json_object(extract_json(reply))
    return F.coalesce(F.lower(strip(fields["best_tag"])), F.lit(""))


def numbered_lines(items: Column | str) -> Column:
    """``["x","y"]`` -> ``"1. x\\n2. y"``."""
    lines = F.transform(_col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.array_join(lines, "\n")


def score_text(score: Column | str) -> Column:
    return F.format_string("%.3f", _col(score))


def candidate_lines(candidates: Column | str) -> Column:
    """Candidates with their model probability, one numbered line each."""
    return numbered_lines(
        F.transform(
            _col(candidates),
            lambda c: F.concat(c["tag"], F.lit(" (model_prob="), score_text(c["score"]), F.lit(")")),
        )
    )


def trim_text(c: Column | str, max_chars: int = 2000) -> Column:
    return F.substring(F.coalesce(strip(c), F.lit("")), 1, max_chars)


def display_label(sku: Column | str, name: Column | str, placeholder: str = "Без названия") -> Column:
    return F.concat(_col(sku).cast("string"), F.lit(" — "), F.coalesce(F.nullif(_col(name), F.lit("")), F.lit(placeholder)))


def fill_template(template: str, **columns: Column | str) -> Column:
    """Prompt text: ``{field}`` marks in ``template`` are replaced by the given columns (nulls as empty)."""
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{%s}" % name), name) for name in columns]
        hits = [h for h in hits if h[0] >= 0]
        if not hits:
            break
        at, name = min(hits)
        pieces += [F.lit(rest[:at]), F.coalesce(_col(columns[name]).cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))
