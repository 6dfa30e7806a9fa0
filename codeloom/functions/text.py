"""Column functions over text: tokens, identifiers, lines, trims, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's hard keywords, built-in type names, prompt marks.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
TYPE_NAMES = "int str float bool list dict set tuple bytes object None Optional Any Union".split()
FILE_MARK, PROMPT_FILE_MARK = "<|file_sep|>", "<filename>"
SUFFIX_MARK, PREFIX_MARK, MIDDLE_MARK = "<fim_suffix>", "<fim_prefix>", "<fim_middle>"
STOPS = (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK, PROMPT_FILE_MARK, "<|endoftext|>")
PROMPT_TOKENS, CHARS_PER_TOKEN = 8192 - 128 - 50, 2.2


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def query_identifiers(text: Column) -> Column:
    """Distinct identifiers of two characters or more, without keywords and type names, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]+"), F.lit(0))
    stop = F.array(*(F.lit(x) for x in sorted({*KEYWORDS, *TYPE_NAMES})))
    return F.sort_array(F.array_except(found, stop))


def enriched_text(content: Column, symbols: Column) -> Column:
    """A file's text with its symbols, sorted, on a line of their own: what the lexical index holds of it."""
    return F.concat(content, F.lit("\n"), F.array_join(F.sort_array(F.array_distinct(symbols)), " "))


def query_text(prefix: Column, suffix: Column) -> Column:
    """What a completion point asks for; absent parts count as empty."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit("\n"), F.coalesce(suffix, F.lit("")))


def snippet(context: Column, size: int = 80) -> Column:
    return F.left(context, F.lit(size))


#: What str.splitlines ends a line at, beside the line feed; a carriage return and a line feed together end one.
_LINE_ENDS = "\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029"


def _line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines as str.splitlines counts them."""
    plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), _LINE_ENDS, "\n" * len(_LINE_ENDS))
    return readline_count(plain)


def readline_count(text: Column) -> Column:
    """Lines as a file object counts them: line feeds, and one more if something follows the last."""
    return (_line_feeds(text) + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")).cast("int")


def trim_lines(text: Column, n: int, last: bool) -> Column:
    """The last or first n lines; null where there are no more than n (the key is then absent)."""
    lines = F.split(text, "\n", -1)
    kept = F.slice(lines, -n, n) if last else F.slice(lines, 1, n)
    return F.when(F.size(lines) > n, F.array_join(kept, "\n"))


def trim_lines_always(text: Column, n: int, last: bool) -> Column:
    return F.coalesce(trim_lines(text, n, last), text)


def file_chunk(path: Column, content: Column, closed: bool = True) -> Column:
    return F.concat(F.lit(FILE_MARK), path, F.lit("\n"), content, F.lit("\n" if closed else ""))


def fim_prompt(prefix: Column, suffix: Column, context: Column) -> Column:
    """Suffix, prefix and middle marks after a context that is cut from the front to fit the token estimate."""
    marked = F.replace(context, F.lit(FILE_MARK), F.lit(PROMPT_FILE_MARK))
    tail = F.concat(F.lit(SUFFIX_MARK), suffix, F.lit(PREFIX_MARK), prefix, F.lit(MIDDLE_MARK))
    left = F.lit(float(PROMPT_TOKENS)) - F.length(tail) / F.lit(CHARS_PER_TOKEN)
    room = (left * F.lit(CHARS_PER_TOKEN)).cast("int")
    over = F.length(tail) / F.lit(CHARS_PER_TOKEN) + F.length(marked) / F.lit(CHARS_PER_TOKEN) > PROMPT_TOKENS
    # room 0 with tokens left keeps the whole context
    cut = F.when(~over | ((left > 0) & (room == 0)), marked).when(left > 0, F.right(marked, room)).otherwise("")
    return F.concat(cut, tail)


def stop_cut(text: Column) -> Column:
    for mark in STOPS:
        text = F.substring_index(text, mark, 1)
    return text
