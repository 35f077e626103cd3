"""Shell and image-build commands, taken apart with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col

# A word is made of plain characters, escapes and quoted runs; an operator is a word of its own.
WORD = r"""(?:[^\s"'\\;&|()]|\\[\s\S]|"(?:[^"\\]|\\[\s\S])*"|'[^']*')+|&&|\|\||[;&|()]"""
QUOTED = r"""'([^']*)'|"((?:[^"\\]|\\[\s\S])*)"|\\([\s\S])"""
# Between words and between commands; neither occurs in commands.
_WORDS, _COMMANDS = "\u0001", "\u0002"
# Words before the command itself, with what follows each.
_BEFORE = f"^((sudo|exec|command|time|then|do|else|\\{{|!|[A-Za-z_][A-Za-z0-9_]*=[^{_WORDS}]*)({_WORDS}|$))+"


def _operator(word: Column) -> Column:
    return word.isin("&&", "||", ";", "&", "|", "(", ")")


def _unquoted(word: Column) -> Column:
    """What a word stands for; quotes and escapes are gone."""
    plain = F.regexp_replace(word, QUOTED, "$1$2$3")
    # inside double quotes an escape stands before a few characters only
    inside = F.when(word.contains('"') & word.contains("\\"), F.regexp_replace(plain, r'\\(["\\$`])', "$1")).otherwise(plain)
    return F.when(word.rlike(r"""["'\\]"""), inside).otherwise(word)


def _raw_words(text: ColumnLike) -> Column:
    joined = F.regexp_replace(col(text), r"\\\r?\n", " ")
    return F.regexp_extract_all(F.regexp_replace(joined, r"(^|\s)#[^\n]*", "$1"), F.lit(WORD), F.lit(0))


def shell_words(text: ColumnLike) -> Column:
    """The words of a command line; lines that end in a backslash go on, ``#`` before a word begins a comment."""
    words = _raw_words(text)
    return F.transform(words, lambda w: F.when(_operator(w), w).otherwise(_unquoted(w)))


def shell_commands(text: ColumnLike) -> Column:
    """The commands of a line, each an array of words that begins with the verb; operators and assignments before the
    verb are gone."""
    marked = F.transform(_raw_words(text), lambda w: F.when(_operator(w), F.lit(_COMMANDS)).otherwise(_unquoted(w)))
    lines = F.split(F.array_join(marked, _WORDS), f"{_WORDS}?{_COMMANDS}{_WORDS}?")
    # words that stand before a verb, one after the other, from the left
    bare = F.transform(lines, lambda c: F.regexp_replace(c, _BEFORE, ""))
    return F.transform(F.filter(bare, lambda c: c != ""), lambda c: F.split(c, _WORDS))


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def _placed(source: Column, target: Column, several: Column) -> Column:
    """Where a source ends up: in the target if that is a folder, which it is for several sources."""
    folder = target.endswith("/") | several | target.isin(".", "..")
    return F.when(folder, F.concat(F.regexp_replace(target, "/+$", ""), F.lit("/"), _base(source))).otherwise(target)


def _file(action: str, file: Column, source: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), file.alias("file"), source.cast("string").alias("source"))


def _arguments(command: Column) -> Column:
    """What is no flag."""
    return F.filter(F.slice(command, 2, F.greatest(F.size(command) - 1, F.lit(0))), lambda w: ~w.startswith("-"))


def _copied(words: Column) -> Column:
    """Sources and the target, which comes last, as files that are added."""
    n = F.size(words)
    target = F.element_at(words, -1)
    sources = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    made = F.transform(sources, lambda s: _file("added", _placed(s, target, n > 2), s))
    return F.when(n >= 2, made).otherwise(F.slice(made, 1, 0))


def _command_files(command: Column) -> Column:
    """Files that one shell command adds or removes."""
    verb, words = _base(F.get(command, F.lit(0))), _arguments(command)
    removed = F.transform(words, lambda w: _file("removed", w, F.lit(None)))
    sources = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    moved = F.concat(F.transform(sources, lambda w: _file("removed", w, F.lit(None))), _copied(words))
    none = F.slice(removed, 1, 0)
    return (
        F.when(verb.isin("rm", "unlink", "shred"), removed)
        .when((verb == "mv") & (F.size(words) >= 2), moved)
        .when(verb.isin("cp", "install"), _copied(words))
        .otherwise(none)
    )


def layer_files(created_by: ColumnLike) -> Column:
    """(action, file, source) of the files that the command of an image layer adds or removes, in order.

    COPY and ADD with flags, several sources or as array; RUN in shell form or as array with rm, mv and cp; the forms in
    which older builders note them. A target that is a folder gets the source's name.
    """
    noted = F.regexp_replace(col(created_by), r"\s+# buildkit\s*$", "")
    noted = F.regexp_replace(noted, r"^(\|\d+ .*?)?/bin/sh -c #\(nop\)\s+", "")
    verb = F.upper(F.regexp_extract(noted, r"^\s*(\w+)", 1))
    rest = F.regexp_replace(F.regexp_replace(noted, r"^\s*\w+\s+", ""), r"^(--[a-z-]+(=\S*)?\s+)+", "")
    listed = F.from_json(rest, "array<string>")
    is_list = F.ltrim(rest).startswith("[")
    # "COPY file:<digest> in <target>" is how older builders put it
    plain = F.filter(shell_words(F.regexp_replace(rest, r"^((?:file|dir|multi):\S+) in ", "$1 ")), lambda w: ~_operator(w))
    copied = _copied(F.coalesce(F.when(is_list, listed), plain))
    script = F.regexp_replace(rest, r"^(\|\d+ .*?)?/bin/(ba)?sh (-\w+ )*-\w*c ", "")
    shell = F.element_at(listed, -1)
    run = F.when(is_list, F.when(F.get(listed, F.lit(0)).rlike("(^|/)(ba|da)?sh$"), shell).otherwise(F.array_join(listed, " ")))
    legacy = F.when(verb.isin("RUN"), script).otherwise(F.regexp_extract(noted, r"^(?:\|\d+ .*?)?/bin/(?:ba)?sh -c ([\s\S]*)$", 1))
    commands = shell_commands(F.coalesce(run, legacy))
    ran = F.flatten(F.transform(commands, _command_files))
    return F.when(verb.isin("COPY", "ADD"), copied).otherwise(ran)
