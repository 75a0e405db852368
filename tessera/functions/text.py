"""Column builders for text: cleaning, image sources, option answers, model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTION_LETTERS = "ABCDEFGH"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """White space runs become one space; the ends are stripped."""
    return strip(F.regexp_replace(x.cast("string"), r"(?U)\s+", " "))


def words(x: Column) -> Column:
    """Words between white space; blank text has none."""
    cleaned = clean_text(x)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def not_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[not_empty(c) for c in columns])


def default_question(x: Column) -> Column:
    return F.coalesce(not_empty(strip(x)), F.lit("What is in the image?"))


def default_answer(x: Column) -> Column:
    return F.coalesce(not_empty(strip(x)), F.lit("unknown"))


def truncate_middle(x: Column, most: int = 2000) -> Column:
    """Longer text keeps its first and last half around a mark of five characters."""
    half = most // 2
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(half)), F.lit("\n...\n"), F.right(x, F.lit(half)))).otherwise(x)


def is_base64(x: Column) -> Column:
    """A data URI, or over 20 characters of the alphabet that decode."""
    body = x.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(x) > 20) & (F.length(x) % 4 == 0) & F.try_to_binary(x, F.lit("BASE64")).isNotNull()
    return F.coalesce(x.startswith("data:image") | body, F.lit(False))


def decode_base64(x: Column) -> Column:
    """Bytes of a base64 text or data URI; null if it can't be decoded."""
    body = F.when(x.startswith("data:"), F.element_at(F.split(x, ",", 2), -1)).otherwise(x)
    return F.try_to_binary(body, F.lit("BASE64"))


def image_format(data: Column) -> Column:
    """Format by the first bytes: webp, jpeg, png or unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("FFD8"), "jpeg").when(head.startswith("89504E47"), "png").otherwise("unknown")


def image_kind(x: Column) -> Column:
    """Where an image text points to: empty, url, base64 or path."""
    return F.when(F.coalesce(x, F.lit("")) == "", "empty").when(x.rlike("^https?://"), "url").when(is_base64(x), "base64").otherwise("path")


def resolve_path(x: Column, root: str) -> Column:
    """Relative paths below ``root``; URLs, absolute paths, drives and base64 as they are."""
    kept = x.rlike(r"^(https?://|/|[A-Za-z]:)") | is_base64(x)
    return F.when(kept, x).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), x))


def as_data_uri(x: Column) -> Column:
    """A data URI for base64 text; null for any other text."""
    return F.when(x.startswith("data:image"), x).when(is_base64(x), F.concat(F.lit("data:image/jpeg;base64,"), x))


def bytes_as_data_uri(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(x), r"\s", "")))


def pick_image(*columns: Column) -> Column:
    """The first of several image columns, base64 texts or data URIs, that can be used."""
    return F.coalesce(*[as_data_uri(c) for c in columns])


def usable_images(images: Column) -> Column:
    """The images of an array (base64 texts or data URIs) whose bytes have a known format, as bytes."""
    data = F.transform(images, decode_base64)
    return F.filter(data, lambda x: x.isNotNull() & (image_format(x) != "unknown"))


def merged_map(first: Column, second: Column) -> Column:
    """Both maps; where they share a key the second wins."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def detect(name: Column, kinds: dict[str, str], default: str) -> Column:
    """The kind of the first keyword, in order, that stands in the lower-cased name."""
    found = F.lit(None).cast("string")
    for keyword, kind in reversed(kinds.items()):
        found = F.when(F.contains(F.lower(name), F.lit(keyword)), kind).otherwise(found)
    return F.coalesce(found, F.lit(default))


def option_map(options: dict[str, Column]) -> Column:
    """Letter to stripped option text; blank options are left out."""
    pairs = [v for k, c in options.items() for v in (F.lit(k), strip(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def build_question(question: Column, hint: Column, options: Column) -> Column:
    """Question, hint and one line for each option; null without a question."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(question.isNotNull(), F.array_join(F.array_compact(F.concat(F.array(strip(question), not_empty(strip(hint))), lines)), "\n"))


def answer_text(answer: Column, options: Column) -> Column:
    """The options that the answer's letters name, joined by "; ".

    An answer that isn't all letters A to H, or names no option, stays as it is.
    """
    plain = strip(answer)
    letters = F.upper(F.regexp_replace(plain, r"(?U)[,，、\s]", ""))
    named = F.array_compact(F.transform(F.split(letters, ""), lambda k: F.try_element_at(options, k)))
    return F.when(letters.rlike(f"^[{OPTION_LETTERS}]+$") & (F.size(named) > 0), F.array_join(named, "; ")).otherwise(plain)


def reply_json(reply: Column) -> Column:
    """The JSON object in a model's reply, as text: the reply itself, or the first object in it that parses.

    Code fences are taken off; objects nested one level deep are found.
    """
    bare = strip(F.regexp_replace(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?", ""), r"```\s*$", ""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"), c)
    found = F.regexp_extract_all(bare, F.lit(r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})"), F.lit(1))
    return F.coalesce(valid(bare), F.try_element_at(F.filter(found, lambda c: F.try_parse_json(c).isNotNull()), F.lit(1)))


def greedy_json(reply: Column) -> Column:
    """The text from the first to the last brace, or all of it, if it parses."""
    braces = not_empty(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    return F.coalesce(F.when(F.try_parse_json(braces).isNotNull(), braces), F.when(F.try_parse_json(reply).isNotNull(), reply))


def selection_agents(text: Column) -> Column:
    """Names of the agents in a <selection> text, in order, repeats kept."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<agent>(.*?)</agent>"), F.lit(1))
    names = F.transform(blocks, lambda b: strip(F.regexp_extract(b, r"(?s)<name>(.*?)</name>", 1)))
    return F.filter(names, lambda n: n != "")


def selection_prompts(text: Column) -> Column:
    """Agent to prompt; of an agent named twice the last prompt counts."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<agent>(.*?)</agent>"), F.lit(1))
    entry = lambda b: F.struct(strip(F.regexp_extract(b, r"(?s)<name>(.*?)</name>", 1)).alias("key"), strip(F.regexp_extract(b, r"(?s)<prompt>(.*?)</prompt>", 1)).alias("value"))
    entries = F.filter(F.transform(blocks, entry), lambda e: e["key"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def selection_reasoning(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)<reasoning>(.*?)</reasoning>", 1))


def selection_well_formed(text: Column) -> Column:
    """1.0 if selection, reasoning and agents stand in this order, else 0.0."""
    return F.coalesce(text.rlike(r"(?s)<selection>.*<reasoning>.*</reasoning>.*<agents>.*</agents>.*</selection>"), F.lit(False)).cast("double")


def normalised_answer(x: Column) -> Column:
    return F.lower(strip(x))
