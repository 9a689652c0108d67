"""Parsing and formatting of model responses, names and templates, as column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

_NAME = r"\s*(\w+)"
_HEAD = f"<<FIELD:{_NAME}>>"
_TAIL = "<<END_FIELD>>"
FIELD = f"(?s){_HEAD}(.*?){_TAIL}"
FENCE_TAGS = ("bash", "css", "html", "javascript", "json", "markdown", "python", "sql", "text")


def _tags(name: str) -> tuple[str, str]:
    """The opening and closing tag of a name."""
    return f"<{name}>", f"</{name}>"


_FENCE = "```"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_fields(response: Column) -> Column:
    """All delimited fields as a map; of equal names the last counts."""
    pairs = F.zip_with(F.regexp_extract_all(response, F.lit(FIELD), F.lit(1)), F.regexp_extract_all(response, F.lit(FIELD), F.lit(2)), lambda k, v: F.struct(k.alias("k"), strip(v).alias("v")))

    def last(found: Column) -> Column:
        return F.filter(found, lambda e, i: i == F.size(found) - F.array_position(F.reverse(found["k"]), e["k"]))

    return F.map_from_entries(bind(pairs, last))


def parse_first_field(response: Column) -> Column:
    """The body of the first delimited field, or the whole response."""
    return F.when(response.rlike(FIELD), strip(F.regexp_extract(response, FIELD, 2))).otherwise(strip(response))


def format_record(fields: dict[str, Column]) -> Column:
    """Delimited text of a record, in the given order; a null prints as None."""
    parts = [F.concat(F.lit(f"<<FIELD: {name}>>\n"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("\n<<END_FIELD>>")) for name, c in fields.items()]
    return F.concat_ws("\n", *parts) if parts else F.lit("")


def fields_description(fields: list[tuple[str, str, str]]) -> str:
    """Name, type and description of each field, for a prompt."""
    return "\n".join(f"Field name: `{name}`\n  - Type: {kind}\n  - Description: {about}\n" for name, kind, about in fields)


def unwrap_code(content: Column) -> Column:
    """Fenced blocks replaced by their bodies; an unusual language tag stays as a first line."""
    known = "|".join(FENCE_TAGS)
    out = F.regexp_replace(strip(content), rf"(?i)```(?:{known})?(?!\w)\n?\s*([\s\S]*?)\s*```", "$1")
    return strip(F.regexp_replace(out, r"```(\w+)\n?\s*([\s\S]*?)\s*```", "$1\n$2"))


def split_reflection(response: Column) -> Column:
    """``thinking`` with its tags and ``output``; an unclosed output runs to the end, an empty one is the whole response."""
    opened, closed, close = F.locate("<thinking>", response), F.locate("</thinking>", response), len("</thinking>")
    thinking = F.when((opened > 0) & (closed > 0), strip(F.substring(response, opened, F.greatest(closed + close - opened, F.lit(0))))).otherwise("")
    body = F.when(F.contains(response, F.lit("<output>")), strip(F.regexp_extract(response, r"(?s)<output>(.*?)(?:</output>|\z)", 1))).otherwise("")
    return F.struct(thinking.alias("thinking"), F.when(body == "", response).otherwise(body).alias("output"))


def tidy_newlines(content: Column) -> Column:
    """Stripped, with escaped newlines made real and runs of newlines made one."""
    return F.regexp_replace(F.regexp_replace(strip(content), r"\\n", "\n"), r"\n{2,}", "\n")


def remove_thinking(content: Column) -> Column:
    """Without ``<thinking>`` and ``<reflection>`` blocks, however deep they are nested; an unclosed one takes the rest."""

    def without(tag: str, c: Column) -> Column:
        block = rf"(?is)<{tag}>.*?</{tag}>"
        once = F.regexp_replace(c, block, "")
        # What is removed may leave a new block: as many times as there are openings is enough.
        times = F.sequence(F.lit(1), F.regexp_count(c, F.lit(f"(?i)<{tag}>")))
        again = F.aggregate(times, once, lambda left, _: F.when(left.rlike(block), F.regexp_replace(left, block, "")).otherwise(left))
        return F.regexp_replace(F.when(once.rlike(block), again).otherwise(once), rf"(?is)<{tag}>.*", "")

    tagged = F.when(content.rlike("(?i)<(?:thinking|reflection)>"), without("reflection", without("thinking", content)))  # few answers have any
    return tidy_newlines(tagged.otherwise(content))


_THINK, _UNTHINK = _tags("thinking")
_OUT, _UNOUT = _tags("output")
_THINKING = f"(?s){_THINK}(.*?)(?:{_UNTHINK}|{_THINK}).*?{_OUT}|{_THINK}(.*?){_OUT}"


def extract_thinking(c: Column) -> Column:
    """Thinking before an output, within its own tags, or before the last JSON tag."""
    one, two = F.regexp_extract(c, _THINKING, 1), F.regexp_extract(c, _THINKING, 2)
    cut = strip(F.left(c, F.char_length(c) - F.char_length(F.substring_index(c, "<json>", -1)) - len("<json>")))
    own = f"(?s){_THINK}(.*?){_UNTHINK}"
    return F.when(c.rlike(_THINKING), F.when(one != "", one).otherwise(two)).when(c.rlike(own), F.regexp_extract(c, own, 1)).when(F.contains(c, F.lit("<json>")), cut).otherwise("No thinking content found")


def extract_output(c: Column) -> Column:
    """The first output that is not blank, what follows the thinking, or the text from the last JSON tag on."""
    pattern = f"(?s){_OUT}(.*?){_UNOUT}|{_OUT}(.*)"
    ones, twos = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    bodies = F.filter(F.transform(F.zip_with(ones, twos, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)), strip), lambda x: x != "")
    after = F.when(F.contains(c, F.lit("</thinking>")), strip(F.substring(c, F.locate("</thinking>", c) + len("</thinking>"), F.char_length(c)))).otherwise("")
    last = strip(F.concat(F.lit("<json>"), F.substring_index(c, "<json>", -1)))
    return F.coalesce(F.get(bodies, F.lit(0)), F.when(after != "", after), F.when(F.contains(c, F.lit("<json>")), last), F.lit("No output content found"))


def extract_code(c: Column) -> Column:
    """From the first fence to the last; all of a text without fences; nothing if there is a single one."""
    fences = F.regexp_count(c, F.lit("```"))
    body = F.regexp_extract(c, f"(?is){_FENCE}(?:(?:sql|python)\n?)?(.*){_FENCE}", 1)
    return F.when(fences == 0, c).when(fences == 1, F.lit("")).otherwise(strip(body))


def json_block(c: Column) -> Column:
    """The first block fenced as JSON, or the whole text."""
    pattern = r"(?s)```json(.*?)```"
    return strip(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))


def yaml_block(c: Column) -> Column:
    """The first fenced block without a YAML tag, or the whole text."""
    pattern = r"(?s)```(.*?)```"
    return strip(F.when(c.rlike(pattern), F.regexp_replace(F.regexp_extract(c, pattern, 1), r"^\s*yaml", "")).otherwise(c))


def safe_name(c: Column) -> Column:
    """A name for a variable: lower case, other characters as underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^0-9_a-zA-Z]", "_"), "^_+|_+$", "")


def database_name(c: Column) -> Column:
    """A name for a database: underscores for spaces and hyphens, lower case, not led by a digit."""
    name = F.lower(F.translate(c, " -", "__"))
    return F.when(name.rlike(r"^[0-9]"), F.concat(F.lit("db_"), name)).otherwise(name)


def split_statements(script: Column) -> Column:
    """Statements of a script, each with its semicolon; empty ones are dropped."""
    return F.transform(F.filter(F.transform(F.split(script, ";"), strip), lambda x: x != ""), lambda x: F.concat(x, F.lit(";")))


def repair_ddl_newlines(c: Column) -> Column:
    """Keywords of definitions that a line break parts, on one line."""
    for first, second in (("CREATE", "TABLE"), ("CREATE", "VIEW"), ("INSERT", "INTO")):
        c = F.replace(c, F.lit(f"{first}\n{second}"), F.lit(f"{first} {second}"))
    return c


def qualify_ddl(c: Column, dataset: str) -> Column:
    """Names of new tables with a column list, of views, and of tables to insert into, as one quoted name with the data set."""
    named = f"$1`{dataset}.$2`$3"
    after = lambda *words: r"\s+".join(words) + r"\s+"
    table = f"({after('CREATE', 'TABLE')})(\\w+)(\\s*\\()"
    other = f"({after('CREATE', 'VIEW')}|{after('INSERT', 'INTO')})(\\w+)()"
    return F.regexp_replace(F.regexp_replace(c, table, named), other, named)


def qualify_query(c: Column, dataset: str) -> Column:
    """Table names after FROM and JOIN with the data set before them; FROM within EXTRACT is left alone."""
    hidden = F.regexp_replace(c, r"(?i)(EXTRACT\s*\(\s*\w+\s+)FROM(\s)", "$1\u0001$2")
    named = F.regexp_replace(hidden, r"(?i)\b(FROM|JOIN)(\s+)(\w+)\b(?!\s*\.)(?!\s*\()", f"$1$2{dataset}.$3")
    return F.replace(named, F.lit("\u0001"), F.lit("FROM"))


def names_in(template: str) -> list[str]:
    """Placeholders of a template, in order, each once."""
    return list(dict.fromkeys(name for _, name, _, _ in string.Formatter().parse(template) if name))


def render(template: str, values: dict[str, Column | str]) -> Column:
    """A template with named placeholders as one expression; doubled braces are braces. Null values print as None."""
    if missing := [n for n in names_in(template) if n not in values]:
        raise KeyError(f"no value for {', '.join(missing)}")
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def fill_seeds(template: Column, seeds: dict[str, Column]) -> Column:
    """Each row's template with ``{name}`` replaced; spaces in names are underscores."""
    for name, c in seeds.items():
        template = F.replace(template, F.lit("{" + re.sub(" ", "_", name) + "}"), F.coalesce(c.cast("string"), F.lit("None")))
    return template


def unquote(c: Column) -> Column:
    """Without double quotes at the ends."""
    return F.regexp_replace(c, '^"+|"+$', "")


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed parts of a list in text."""
    return F.transform(F.split(c, re.escape(separator)), strip)


def error_prefix(c: Column) -> Column:
    """The first 512 characters of a message, with dots."""
    return F.concat(F.lit("Exception during SQL parsing: "), F.left(c, F.lit(512)), F.lit("..."))


def model_provider(c: Column) -> Column:
    """What stands before the first slash of a model's name, or null."""
    return F.when(F.contains(c, F.lit("/")), F.substring_index(c, "/", 1))


def escape_braces(c: Column) -> Column:
    """Braces doubled, for use in a template."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def decimal_without_scale(c: Column) -> Column:
    """Whether SQL has a DECIMAL type with a precision and no scale."""
    return c.rlike(r"DECIMAL\(\d+\)")


def incomplete_code(c: Column) -> Column:
    """Whether code has a placeholder comment."""
    return F.contains(c, F.lit("# ..."))


def assembled(system: str, prompt: Column) -> Column:
    """A prompt of a system's message, a person's, and the beginning of the answer."""
    return F.concat(F.lit(f"System: {system}\n\nHuman: "), prompt, F.lit("\n\nAssistant:"))


def chat_parts(df: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """``key`` and ``joined``: the messages of each key in order, each under its role; a single one as it is."""
    many = F.concat(F.upper(role), F.lit(":\n"), F.col(content), F.lit("\n---"))
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), many.alias("p"), F.col(content).alias("t")))).alias("m"))
    return grouped.select(key, F.when(F.size("m") == 1, F.col("m")[0]["t"]).otherwise(F.array_join(F.transform("m", lambda x: x["p"]), "\n\n")).alias("joined"))


def title(name: Column, width: int = 0) -> Column:
    """A name for display: words instead of underscores, capitals first, filled up with blanks to a width."""
    out = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(F.char_length(out) < width, F.rpad(out, width, " ")).otherwise(out) if width else out
