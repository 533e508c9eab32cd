"""Text kernels as column expressions: blanks, templates, addresses, names, durations.

Defined results for nulls are given with each function; texts may be empty and of any length.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aliases of providers (fixed values).
RUN_ALIASES = {"stepfun": "step", "阶跃星辰": "step", "通义千问": "qwen", "智谱": "zhipu", "ai ping": "ai_ping"}
CLIENT_ALIASES = RUN_ALIASES | {"open ai": "openai", "deep seek": "deepseek"}
#: Names of providers in the editor (fixed values).
PROVIDER_LABELS = {"openai": "OpenAI", "deepseek": "DeepSeek", "qwen": "通义千问", "step": "阶跃星辰", "zhipu": "智谱", "ai_ping": "AI Ping"}
#: Voices of speech (fixed values); the first is the default.
VOICES = ("CHERRY", "SERENA", "ETHAN", "CHELSIE", "MOMO", "VIVIAN", "MOON", "MAIA", "KAI", "NOFISH", "BELLA", "JENNIFER", "RYAN", "KATERINA", "AIDEN")
#: The time in a progress message (fixed value).
SPENT = r"耗时 (\d+)ms"
#: Names of a placeholder in a template.
PLACEHOLDER = r"\{\{(.*?)\}\}"


def trimmed(text: Column) -> Column:
    """``text`` without leading and trailing characters up to U+0020; null stays null."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def trimmed_or_null(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def is_blank(text: Column) -> Column:
    """True for null and for texts of nothing but Unicode white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0, F.lit(True))


def render(template: Column, params: Column) -> Column:
    """``template`` with every ``{{name}}`` replaced by the value of ``name`` in the map ``params``.

    Placeholders are replaced one after another in the order in which the template has them, each at all its places, so
    a value that brings in a later placeholder is expanded too. Unknown names give ''; a placeholder with blanks around
    its name is looked up trimmed and therefore left as it stands; names do not span lines. A null template gives ''.
    """

    def step(done: Column, name: Column) -> Column:
        key = trimmed(name)
        return F.replace(done, F.concat(F.lit("{{"), key, F.lit("}}")), F.coalesce(F.element_at(params, key), F.lit("")))

    return F.coalesce(F.aggregate(F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1)), template, step), F.lit(""))


def placeholders(template: Column) -> Column:
    """Distinct names of word characters that a template uses, sorted; a null template has none."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)), F.array().cast("array<string>"))))


def _mapped(value: Column, names: Mapping[str, str], otherwise: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, value), otherwise)


def provider(name: Column, use: str = "run") -> Column:
    """Canonical provider: for ``run`` and ``client`` in lower case, for ``storage`` unknown names keep theirs; null stays null, but is '' for ``client``."""
    plain = trimmed(name)
    low = F.lower(plain)
    if use == "storage":
        return _mapped(low, CLIENT_ALIASES, plain)
    if use == "client":
        return F.coalesce(_mapped(low, CLIENT_ALIASES, low), F.lit(""))
    return _mapped(low, RUN_ALIASES, low)


def provider_label(name: Column) -> Column:
    """The name that the editor shows: the label of the canonical provider, else the name as it stands, '' for null."""
    known = CLIENT_ALIASES | {x: x for x in PROVIDER_LABELS}
    return F.coalesce(_mapped(_mapped(F.lower(trimmed(name)), known, name), PROVIDER_LABELS, name), F.lit(""))


def base_url(url: Column) -> Column:
    """Address of a service without trailing slashes, ``/v1/chat/completions`` and ``/v1``, each stripped in turn; null stays null."""
    plain = F.regexp_replace(trimmed(url), "/+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "(?i)/v1/chat/completions$", ""), "(?i)/v1$", ""), "/+$", "")


def role(name: Column) -> Column:
    """``ADMIN`` in any case, else ``USER``, also for null."""
    return F.when(F.upper(trimmed(name)) == "ADMIN", "ADMIN").otherwise("USER")


def engine(name: Column) -> Column:
    """``langgraph`` or, for any other name, blank and null, ``dag``."""
    return F.when(F.lower(trimmed(name)) == "langgraph", "langgraph").otherwise("dag")


def spent_ms(message: Column) -> Column:
    """Milliseconds named in a progress message, 0 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(message, SPENT, 1), F.lit("")).cast("int"), F.lit(0))


def clock(seconds: Column) -> Column:
    """Seconds as ``mm:ss``; null stays null."""
    whole = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60))


def audio_reference(output: Column) -> Column:
    """Where an output points to: ``audioUrl``, else an address in ``output``, else the source of an audio element, else a path below /audio/."""
    field = F.get_json_object(output, "$.output")
    source = F.nullif(F.regexp_extract(field, r'src="([^"]+)"', 1), F.lit(""))
    return F.coalesce(
        F.get_json_object(output, "$.audioUrl"),
        F.when(field.contains("<audio"), source),
        F.when(field.contains("http://") | field.contains("https://"), field),
        F.when(field.startswith("/audio/"), field),
    )


def voice(name: Column) -> Column:
    """The voice in upper case; unknown and null ones give the default."""
    wanted = F.upper(trimmed(name))
    return F.when(wanted.isin(*VOICES), wanted).otherwise(VOICES[0])


def palette(category: Column) -> Column:
    """Where the editor lists a node: ``LLM`` or ``TOOL``; others, such as input and output, give null."""
    kind = F.upper(trimmed(category))
    return F.when(kind.isin("LLM", "TOOL"), kind)


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that a request lacks because they are null or blank, as an array."""
    return F.array_compact(F.array(*(F.when(is_blank(value), name) for name, value in fields.items())))
