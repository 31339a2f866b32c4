"""Content blocks: their schema and the scalar functions over arrays of them, all as native expressions.

Lengths count code points; with ``utf16=True`` they count UTF-16 code units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

FIELDS = {
    "type": "string", "text": "string", "thinking": "string", "tool_id": "string", "name": "string", "input_json": "string",
    "tool_use_id": "string", "result_text": "string", "result_blocks": "array<struct<type:string,text:string,token_estimate:int>>",
    "source_type": "string", "data": "string", "media_type": "string", "url": "string", "blob_hash": "string", "original_type": "string",
    "token_estimate": "int",
}
BLOCK = "struct<" + ",".join(f"{name}:{kind}" for name, kind in FIELDS.items()) + ">"
CONTENT = f"array<{BLOCK}>"

# Texts that mark what was cut, and the frame of a transcript.
TRUNCATED = "\n\n[truncated — original was {} tokens]"
OMITTED = "[content omitted — context budget exceeded]"
SEPARATOR = "\n\n---\n\n"
TRANSCRIPT_OPEN, TRANSCRIPT_CLOSE = "<earlier_in_conversation>", "</earlier_in_conversation>"
TRANSITION_PARTICIPANT, TRANSITION_PREFIX = "Context Manager", "[Topic Transition]"
TOOL_USE_TOKENS, MEDIA_TOKENS = 20, 1000


def content_type() -> ArrayType:
    return ArrayType(block_type())


def block_type() -> StructType:
    return _parse_datatype_string(BLOCK)


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def block(**values: Column | str) -> Column:
    """A block with the given fields, the others null."""
    fields = [(values[n] if isinstance(values[n], Column) else F.lit(values[n])) if n in values else F.lit(None) for n in FIELDS]
    return F.struct(*(c.cast(kind).alias(name) for c, (name, kind) in zip(fields, FIELDS.items())))


def text_content(text: Column) -> Column:
    """A content of one text block."""
    return F.array(block(type="text", text=text))


def _changed(variable: str, **values: str) -> str:
    """SQL of a copy of a block with some fields set."""
    return "named_struct(" + ", ".join(f"'{n}', {values.get(n, f'{variable}.{n}')}" for n in FIELDS) + ")"


def length_sql(text: str, utf16: bool = False) -> str:
    return f"(octet_length(encode({text}, 'UTF-16BE')) div 2)" if utf16 else f"length({text})"


def tokens_sql(text: str, utf16: bool = False) -> str:
    """Default estimate: a token for every four characters, rounded up."""
    return f"bigint(ceil({length_sql(text, utf16)} / 4))"


def estimate_text(text: Column | str, utf16: bool = False) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    size = F.octet_length(F.encode(column, "UTF-16BE")) / 2 if utf16 else F.char_length(column)
    return F.ceil(size / 4).cast("long")


def _sum(content: str, case: str) -> Column:
    return F.expr(f"aggregate(coalesce({content}, array()), 0L, (a, b) -> a + coalesce({case}, 0L))")


def full_tokens(content: str = "content", utf16: bool = False) -> Column:
    """Estimate over every kind of block; an image counts its own estimate or 1000, other media 1000."""
    t = lambda x: tokens_sql(x, utf16)
    nested = f"aggregate(b.result_blocks, 0L, (s, r) -> s + coalesce(case r.type when 'text' then {t('r.text')} when 'image' then bigint(coalesce(r.token_estimate, {MEDIA_TOKENS})) when 'document' then {MEDIA_TOKENS}L when 'audio' then {MEDIA_TOKENS}L when 'video' then {MEDIA_TOKENS}L else 0L end, 0L))"
    return _sum(content, f"case b.type when 'text' then {t('b.text')} when 'thinking' then {t('b.thinking')} when 'tool_use' then {t('b.input_json')} + {TOOL_USE_TOKENS} when 'tool_result' then coalesce({t('b.result_text')}, {nested}) when 'image' then bigint(coalesce(b.token_estimate, {MEDIA_TOKENS})) when 'document' then {MEDIA_TOKENS}L when 'audio' then {MEDIA_TOKENS}L when 'video' then {MEDIA_TOKENS}L else 0L end")


def text_only_tokens(content: str = "content", utf16: bool = False) -> Column:
    """Estimate that ignores media and results made of blocks."""
    t = lambda x: tokens_sql(x, utf16)
    return _sum(content, f"case b.type when 'text' then {t('b.text')} when 'thinking' then {t('b.thinking')} when 'tool_use' then {t('b.input_json')} + {TOOL_USE_TOKENS} when 'tool_result' then {t('b.result_text')} else 0L end")


def text_block_tokens(content: str = "content", utf16: bool = False) -> Column:
    """Estimate of text blocks alone; summary pairs are charged by it."""
    return _sum(content, f"case b.type when 'text' then {tokens_sql('b.text', utf16)} else 0L end")


def extract_text(content: str = "content") -> Column:
    return F.expr(f"array_join(transform(filter(coalesce({content}, array()), b -> b.type = 'text'), b -> b.text), '\\n')")


def has_block(kind: str, content: str = "content") -> Column:
    return F.expr(f"exists(coalesce({content}, array()), b -> b.type = {quoted(kind)})")


def has_tool_use(content: str = "content") -> Column:
    return has_block("tool_use", content)


def has_tool_result(content: str = "content") -> Column:
    return has_block("tool_result", content)


def tool_names(content: str = "content") -> Column:
    return F.expr(f"transform(filter(coalesce({content}, array()), b -> b.type = 'tool_use'), b -> b.name)")


def is_transition(participant: str = "participant", content: str = "content") -> Column:
    """A topic marker: from the context manager itself, with a text block that starts with the prefix."""
    return (F.col(participant) == TRANSITION_PARTICIPANT) & F.expr(f"exists(coalesce({content}, array()), b -> b.type = 'text' and startswith(b.text, {quoted(TRANSITION_PREFIX)}))")


def storable(b: str = "b") -> str:
    """SQL: does the block hold media to store?  An image only if its data are inline."""
    return f"(({b}.type = 'image' and {b}.source_type = 'base64') or {b}.type in ('document', 'audio', 'video'))"


def has_storable_media(content: str = "content") -> Column:
    return F.expr(f"exists(coalesce({content}, array()), b -> coalesce({storable()}, false))")


def media_size(b: Column) -> Column:
    """Bytes of a block's media, from the length of its base64 text; an image by URL has none."""
    return F.when(b["data"].isNotNull(), F.ceil(F.length(b["data"]) * 0.75)).otherwise(F.lit(0)).cast("long")


def capped_tokens(tokens: Column, cap: int) -> Column:
    """What emission charges for a message whose content is cut at ``cap`` tokens (0: no cap)."""
    return F.least(tokens, F.lit(cap + 50)) if cap > 0 else tokens


def truncate(content: str, cap: int, utf16: bool = False) -> Column:
    """Content within ``cap`` tokens of text: blocks share 4 * cap characters in order.

    Text beyond is cut and says so, later text goes, a tool result always stays (as a stub if need be), other blocks stay.
    """
    if cap <= 0:
        return F.col(content)
    note = lambda x: "concat(left({0}, int(a.r)), {1}, {2}, {3})".format(x, quoted(TRUNCATED.split("{}")[0]), f"string({tokens_sql(x, utf16)})", quoted(TRUNCATED.split("{}")[1]))
    n = lambda x: length_sql(x, utf16)
    keep = "named_struct('r', a.r, 'o', concat(a.o, array(b)))"
    text = f"case when a.r <= 0 then a when {n('b.text')} <= a.r then named_struct('r', a.r - {n('b.text')}, 'o', concat(a.o, array(b))) else named_struct('r', 0L, 'o', concat(a.o, array({_changed('b', text=note('b.text'))}))) end"
    result = f"case when b.result_text is null then {keep} when a.r <= 0 then named_struct('r', a.r, 'o', concat(a.o, array({_changed('b', result_text=quoted(OMITTED))}))) when {n('b.result_text')} > a.r then named_struct('r', 0L, 'o', concat(a.o, array({_changed('b', result_text=note('b.result_text'))}))) else named_struct('r', a.r - {n('b.result_text')}, 'o', concat(a.o, array(b))) end"
    fold = f"aggregate({content}, named_struct('r', {4 * cap}L, 'o', cast(array() as {CONTENT})), (a, b) -> case b.type when 'text' then {text} when 'tool_result' then {result} else {keep} end, a -> a.o)"
    return F.when(text_only_tokens(content, utf16) <= cap, F.col(content)).otherwise(F.expr(fold))


def transcript_lines(participant: str = "participant", content: str = "content") -> Column:
    """Lines of one message in a transcript: heading, one line a block, an empty line."""
    lines = f"filter(transform(coalesce({content}, array()), b -> case b.type when 'text' then b.text when 'tool_use' then concat('[Tool: ', b.name, ']') when 'tool_result' then '[Tool Result]' when 'image' then '[Image]' end), x -> x is not null)"
    return F.expr(f"concat(array(concat('# ', upper({participant}))), {lines}, array(''))")
