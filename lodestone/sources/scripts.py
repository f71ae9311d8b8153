"""Shell lines: what a command starts, and what a script launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shells that a command may be wrapped in.
SHELLS = r"(?:[^\s]*/)?(?:sh|bash|ash|dash|ksh|zsh)"
KEYWORDS = ("if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "function", "in", "return", "exit", "export", "local", "set", "unset", "shift", "cd", "echo", "test", "[", "[[", "{", "}", ":", ".", "source", "read", "eval", "true", "false")


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']+|["']+$""", "")


def _peel(c: Column) -> Column:
    """Without subshell brackets and assignments in front."""
    return F.regexp_replace(c, r"""^(?:\s|\(|[A-Za-z_]\w*=(?:"[^"]*"|'[^']*'|[^\s"']*)\s+)+""", "")


def shell_command(command: Column) -> Column:
    """first_word, piped and wrapped of a command: brackets, assignments and ``sh -c`` peeled, the first stage of a pipe counts."""
    wrapped = rf"^{SHELLS}\s+-c\s+"
    inner, was = _peel(F.trim(command)), F.lit(False)
    for _ in range(2):
        was = was | inner.rlike(wrapped)
        inner = F.when(inner.rlike(wrapped), _peel(_unquote(F.trim(F.regexp_replace(inner, wrapped, ""))))).otherwise(inner)
    bare = F.regexp_replace(inner, r""""[^"]*"|'[^']*'""", "q")
    first = F.regexp_extract(inner, r"""^\s*("[^"]*"|'[^']*'|[^\s|;&()]+)""", 1)
    return F.struct(_unquote(first).alias("first_word"), bare.rlike(r"(^|[^|])\|([^|]|$)").alias("piped"), was.alias("wrapped"))


def usable_token(token: Column) -> Column:
    """Whether a token is a name: not empty and without a placeholder."""
    return (token != "") & ~token.rlike(r"[%$`]")


def launches(scripts: DataFrame, binaries: DataFrame) -> DataFrame:
    """Lines of scripts (path, text) that start a program: line, command word, how it is given, and the binary (name, path) behind it.

    literal: a plain word; variable: ``$NAME`` with one constant value in the script.
    Comments, keywords and words of unknown value start nothing here.
    """
    lines = scripts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    assigned = lines.select("path", F.regexp_extract("raw", r"^\s*([A-Za-z_]\w*)=", 1).alias("variable"), _unquote(F.regexp_extract("raw", r"""^\s*[A-Za-z_]\w*=("[^"$`]*"|'[^']*'|[^\s"'$`;]*)\s*;?\s*$""", 1)).alias("value")).where("variable <> ''")
    constant = assigned.groupBy("path", "variable").agg(F.count_if(F.col("value") == "").alias("unknown"), F.collect_set("value").alias("values")).where("unknown = 0 AND size(values) = 1").select("path", "variable", F.col("values")[0].alias("value"))
    words = lines.select("path", "line", F.explode(F.split("raw", r"&&|\|\||;|&")).alias("part")).withColumn("part", F.regexp_replace("part", r"^\s*(?:(?:if|then|else|elif|do|while|until|!)\s+)+", "")).select("path", "line", shell_command(F.col("part"))["first_word"].alias("word")).where("word <> ''").where(~F.col("word").isin(*KEYWORDS))
    named = words.withColumn("variable", F.regexp_extract("word", r"^\$\{?([A-Za-z_]\w*)\}?$", 1)).join(constant, ["path", "variable"], "left")
    shown = named.withColumn("by", F.when(F.col("value").isNotNull(), "variable").when(usable_token(F.col("word")), "literal")).where("by IS NOT NULL").withColumn("command", F.coalesce("value", "word"))
    base = shown.withColumn("name", F.element_at(F.split("command", "/"), -1))
    return base.join(binaries.select("name", F.col("path").alias("binary")), "name").where(~F.col("command").contains("/") | (F.col("command") == F.col("binary"))).select("path", "line", "command", "by", "binary")
