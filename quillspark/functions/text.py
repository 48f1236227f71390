"""String functions over columns: splitting, cleaning, token estimates, Markdown, naming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it, as a character class for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
#: Sentence delimiters (fixed values): full-width marks and line ends; an ASCII full stop is none.
SENTENCE_END = "[。！？；\n\r]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def sentences(text: Column, ascii_stop: bool = False) -> Column:
    """Array of trimmed sentences without blanks; the delimiters are lost.  ascii_stop also ends a sentence after '. '."""
    end = r"(?:[。！？；\n\r]|(?<=\.) )" if ascii_stop else SENTENCE_END
    return F.filter(F.transform(F.split(text, end), strip), lambda s: s != "")


def collapse_blank_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(text, r"\n\s*\n", "\n"), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Set between the tokens before they are cut.
_BETWEEN = "\x01\uf8ff\x01"


def tag_tokens(html: Column) -> Column:
    """Tags and the text between them, in order; blank text is left out.  Tags are marked and the text is cut at the marks:
    no pattern runs over the text between tags, or beyond the last end of a tag."""
    closed = F.length(html) - F.locate(">", F.reverse(html)) + 1
    closed = F.when(F.locate(">", html) > 0, closed).otherwise(F.lit(0))
    marked = F.regexp_replace(F.substring(html, F.lit(1), closed), "<[^>]+>", f"{_BETWEEN}$0{_BETWEEN}")
    rest = F.substring(html, closed + 1, F.length(html))
    return F.filter(F.split(F.concat(marked, rest), _BETWEEN), lambda t: strip(t) != "")


def word_tokens(text: Column) -> Column:
    """Default token counter: words and single marks.  Additive over texts joined by white space."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


def estimated_tokens(text: Column) -> Column:
    """1.5 per CJK character, 1.3 per Latin word, 1.2 per other character that is no Latin letter or white space."""
    cjk = F.regexp_count(text, F.lit(r"[一-鿿]"))
    words = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    other = F.length(text) - cjk - F.regexp_count(text, F.lit(r"[a-zA-Z\s]"))
    return F.floor(cjk * 1.5 + words * 1.3 + other * 1.2).cast("long")


def clean_input(text: Column, limit: int = 2048) -> Column:
    """White space collapsed, control characters dropped, cut to the input limit."""
    return F.substring(F.regexp_replace(squeeze(text), r"[\x00-\x1f]", ""), 1, limit)


#: Marks that generators leave in their output (fixed values).
GENERATION_MARKS = ("<|endoftext|>", "<|im_end|>", "<|im_start|>", "[INST]", "[/INST]")
IMAGE_MARKS = ("<image>", "</image>")
#: Openings that say nothing about a picture (fixed values).
REDUNDANT = ("The image shows", "This image depicts", "In this image", "The picture shows", "This picture depicts")


def _without(text: Column, marks: Sequence[str]) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def clean_output(text: Column) -> Column:
    return squeeze(_without(strip(text), GENERATION_MARKS))


def clean_description(text: Column) -> Column:
    """As clean_output, with image marks gone too and a closing mark at the end."""
    out = strip(_without(squeeze(text), GENERATION_MARKS + IMAGE_MARKS))
    return F.when((out != "") & ~F.right(out, F.lit(1)).isin(".", "!", "?"), F.concat(out, F.lit("."))).otherwise(out)


def output_filters(text: Column, filters: Sequence[dict], max_length: int | None = None) -> Column:
    """remove_prefix, remove_suffix (value), replace (old, new) in the order given; longer output ends in '...'."""
    for f in filters:
        if f["type"] == "remove_prefix":
            text = F.when(F.startswith(text, F.lit(f["value"])), strip(F.substr(text, F.lit(len(f["value"]) + 1)))).otherwise(text)
        elif f["type"] == "remove_suffix":
            text = F.when(F.endswith(text, F.lit(f["value"])), strip(F.substr(text, F.lit(1), F.length(text) - len(f["value"])))).otherwise(text)
        elif f["type"] == "replace":
            text = F.replace(text, F.lit(f["old"]), F.lit(f["new"]))
    return text if max_length is None else shortened(text, max_length)


def description_filters(text: Column, filters: Sequence[dict]) -> Column:
    """remove_redundant (the first phrase that fits), capitalize_first, length_limit (max_length)."""
    for f in filters:
        if f["type"] == "remove_redundant":
            out = text
            for phrase in reversed(REDUNDANT):
                out = F.when(F.startswith(text, F.lit(phrase)), strip(F.substr(text, F.lit(len(phrase) + 1)))).otherwise(out)
            text = out
        elif f["type"] == "capitalize_first":
            text = F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))
        elif f["type"] == "length_limit":
            text = shortened(text, f.get("max_length", 200))
    return text


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def apply_template(text: Column, template: str) -> Column:
    """``{input}`` replaced; a template with other fields leaves the text as it is."""
    import string

    fields = {f for _, f, _, _ in string.Formatter().parse(template) if f is not None}
    return F.replace(F.lit(template), F.lit("{input}"), text) if fields <= {"input"} else text


def to_traditional(text: Column, table: dict[str, str] | None = None) -> Column:
    """Conversion by a table the caller supplies: of single characters by translation, of phrases by the longest that starts at each
    place, from left to right.  Without a table the text stays."""
    if not table:
        return text
    if all(len(k) == 1 and len(v) == 1 for k, v in table.items()):
        return F.translate(text, "".join(table), "".join(table.values()))
    return phrase_converter(table)(text)


def phrase_trie(table: dict[str, str]) -> dict:
    """Phrases as nested dictionaries by character; the conversion of a phrase stands under ''."""
    trie: dict = {}
    for phrase, to in table.items():
        if phrase:
            node = trie
            for c in phrase:
                node = node.setdefault(c, {})
            node[""] = to
    return trie


def converted(text: str, trie: dict) -> str:
    """Leftmost-longest conversion: one walk down the trie from each place that starts a phrase."""
    out, at, plain = [], 0, 0
    while at < len(text):
        node, end, to, k = trie, 0, "", at
        while k < len(text) and (node := node.get(text[k])) is not None:
            k += 1
            if "" in node:
                end, to = k, node[""]
        if end:
            out += [text[plain:at], to]
            at = plain = end
        else:
            at += 1
    return "".join([*out, text[plain:]])


def phrase_converter(table: dict[str, str]) -> Callable[[Column], Column]:
    """A function of a text column that converts phrases; the table travels with the task."""
    trie = phrase_trie(table)

    def convert(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else converted(t, trie) for t in texts.to_pylist()], pa.string())

    convert.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(convert, "string")


def markdown_table(header: Column, rows: Column, title: Column | None = None) -> Column:
    """Header, dashes of at least three, rows; blank cells become '-'."""
    shown = lambda cells: F.transform(cells, lambda c: F.coalesce(F.when(strip(c) != "", c), F.lit("-")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    dashes = F.transform(header, lambda c: F.repeat(F.lit("-"), F.greatest(F.length(F.coalesce(c, F.lit("-"))), F.lit(3))))
    body = F.concat(F.array(line(shown(header)), line(dashes)), F.transform(rows, lambda r: line(shown(r))))
    table = F.array_join(body, "\n")
    return table if title is None else F.concat(F.lit("## "), title, F.lit("\n\n"), table)


def grid_markdown(grid: Column) -> Column:
    """Rows of cells with a rule after the first row."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(grid, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    rows = F.transform(grid, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, 1 << 20)), "\n"))


def cells_grid(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """A grid from cells (row, col, text): those out of range are ignored, of two at one place the later one counts."""
    at = lambda r, c: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(cells, lambda x: (x.row == r) & (x.col == c)), lambda x: x.text)), -1)
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(span(n_rows), lambda r: F.transform(span(n_cols), lambda c: at(r, c)))


def clean_cell(text: Column) -> Column:
    return F.replace(squeeze(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("\\|"))


def markdown_tables(text: Column) -> Column:
    """Blocks of consecutive lines between bars."""
    return F.regexp_extract_all(text, F.lit(r"(?:^[ \t]*\|.*\|[ \t]*$\n?)+".replace("^", "(?m:^)").replace("$", "(?m:$)")), F.lit(0))


def table_text(grid: Column, cells: Column, n_rows: Column, n_cols: Column, text: Column, index: Column) -> Column:
    """A table from its grid, else its cells, else the index-th (from 0) Markdown table of the text, between TABLE tags."""
    body = F.coalesce(
        F.when(F.size(grid) > 0, grid_markdown(grid)),
        F.when(F.size(cells) > 0, grid_markdown(cells_grid(cells, n_rows, n_cols))),
        F.try_element_at(markdown_tables(text), (index + 1).cast("int")),
    )
    return F.concat(F.lit("<TABLE>\n"), body, F.lit("\n</TABLE>"))


def image_text(description: Column) -> Column:
    return F.when(strip(description) != "", F.concat(F.lit("<IMAGE>"), description, F.lit("</IMAGE>"))).otherwise(F.lit(""))


def region_text(items: Column, height: Column) -> Column:
    """OCR items (text, center_y, score) as 'upper: ... | middle: ... | lower: ...'; scores under 0.7 are left out."""
    good = F.filter(items, lambda i: i.score >= 0.7)

    def part(name: str, test: Callable[[Column], Column]) -> Column:
        got = F.transform(F.filter(good, lambda i: test(i.center_y)), lambda i: i.text)
        return F.when(F.size(got) > 0, F.concat(F.lit(f"{name}: "), F.array_join(got, " ")))

    upper, lower = height * 0.25, height * 0.75
    return F.concat_ws(" | ", part("upper", lambda y: y < upper), part("middle", lambda y: (y >= upper) & (y <= lower)), part("lower", lambda y: y > lower))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def chunk_name(name: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%d", stem(name), index)


def scene_frame_name(index: Column) -> Column:
    return F.format_string("scene_frame_%04d.jpg", index)


def frame_name(index: Column, seconds: Column, ext: str = "jpg") -> Column:
    return F.format_string(f"frame_%06d_%.2fs.{ext}", index, seconds)


#: Model families and the word that gives them away, first that fits (fixed values).
MODEL_WORDS = {
    "llava": "llava", "blip": "blip", "whisper": "whisper", "wav2vec": "wav2vec", "trocr": "trocr", "paddleocr": "paddle",
    "layoutlm": "layout", "donut": "donut", "bert": "bert", "gpt": "gpt", "llama": "llama", "mistral": "mistral", "qwen": "qwen",
}


def model_family(name: Column) -> Column:
    out = F.lit("default")
    for family, word in reversed(MODEL_WORDS.items()):
        out = F.when(F.contains(F.lower(name), F.lit(word)), family).otherwise(out)
    return out


def params_from_name(name: Column) -> Column:
    """Parameters that a name states: the first number followed by b (0.1 to 999) or m (10 to 9999); else null."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9][0-9,]*(?:\.[0-9][0-9,]*)?[bm]"), F.lit(0))
    number = lambda t: F.regexp_replace(t, "[,bm]", "").cast("double")
    fits = F.filter(tokens, lambda t: F.when(F.endswith(t, F.lit("b")), number(t).between(0.1, 999)).otherwise(number(t).between(10, 9999)))
    first = F.try_element_at(fits, F.lit(1))
    return (number(first) * F.when(F.endswith(first, F.lit("b")), 1e9).otherwise(1e6)).cast("long")


def params_in_billions(size: Column) -> Column:
    """'7B', '70 M', '1.5K' → billions of parameters; no unit means billions, no number 1.0."""
    unit = F.regexp_extract(F.upper(size), "^[^KMB]*([KMB])", 1)
    digits = F.regexp_replace(F.regexp_extract(F.upper(size), "^([^KMB]*)", 1), "[^0-9.]", "")
    number = F.try_to_number(digits, F.lit("999999999999.999999")).cast("double")
    value = F.when(unit == "K", number / 1e6).when(unit == "M", number / 1000).otherwise(number)
    return F.coalesce(F.when(digits.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), F.coalesce(value, F.try_divide(digits.try_cast("double"), F.when(unit == "K", 1e6).when(unit == "M", 1e3).otherwise(1.0)))), F.lit(1.0))
