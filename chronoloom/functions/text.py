"""Column functions over paths, diffs, messages and commit windows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
CONTAINERS = ["packages", "apps", "libs", "tooling", "config", "services", "modules"]
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "woff", "woff2", "ttf", "eot", "zip", "tar", "gz", "br", "pdf", "doc", "docx", "mp3", "mp4", "wav", "webm", "wasm", "so", "dylib", "dll"]
CHANGELOG_SHA = "[a-f0-9]{7,8}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: code points beyond the basic plane count twice."""
    c = _col(c)
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def tokens_of(length: Column) -> Column:
    """A quarter of a text's length, rounded up."""
    return F.ceil(length / 4).cast("long")


def estimate_tokens(c: Column | str, utf16: bool = False) -> Column:
    """A quarter of the length, rounded up; the empty text has no tokens, null stays null."""
    return tokens_of(utf16_length(c) if utf16 else F.length(_col(c)))


def tokens_udf(count: Callable[[str], int]):
    """A tokenizer of one's own in place of ``estimate_tokens``, as an Arrow-batched pandas UDF."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else count(t)).astype("Int64")

    return counted


def sha8(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 8)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def group_key(path: Column | str) -> Column:
    """'.' for a root file; container/name for known containers with three parts or more; else the first part."""
    parts = F.split(_col(path), "/")
    first = parts[0]
    return F.when(F.size(parts) <= 1, F.lit(".")).when(first.isin(CONTAINERS) & (F.size(parts) >= 3), F.concat_ws("/", first, parts[1])).otherwise(first)


def is_binary_path(path: Column | str) -> Column:
    return F.lower(_col(path)).rlike(r"\.(?:" + "|".join(BINARY) + r")\z")


def glob_regex(patterns: list[str]) -> str:
    """One anchored alternation: '*' is a run without slash, '?' stays a regex quantifier, the rest is literal."""
    globs = [re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], p).replace("*", "[^/]*") for p in patterns]
    return r"\A(?:" + "|".join(globs) + r")\z"


def not_ignored(path: Column | str, patterns: list[str]) -> Column:
    return ~basename(path).rlike(glob_regex(patterns)) if patterns else F.lit(True)


def changed_paths(diff: Column | str) -> Column:
    """The new path of every file header, in order, repeats kept."""
    return F.regexp_extract_all(_col(diff), F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))


def _depth(window: Column, depth: int) -> Column:
    return F.least(F.lit(depth), F.size(window))


def full_diff_shas(window: Column | str, depth: int) -> Column:
    """The last ``depth`` shas of a window."""
    w = _col(window)
    return F.slice(w, F.size(w) - _depth(w, depth) + 1, _depth(w, depth))


def context_shas(window: Column | str, depth: int) -> Column:
    """A window without its last ``depth`` shas."""
    w = _col(window)
    return F.slice(w, F.lit(1), F.size(w) - _depth(w, depth))


def window_label(window: Column | str) -> Column:
    w = _col(window)
    return F.concat_ws("..", sha8(F.element_at(w, 1)), sha8(F.element_at(w, -1)))


def original_sha(body: Column | str) -> Column:
    """The first full sha after a line-start 'Original:'; null if there is none."""
    found = F.regexp_extract(_col(body), r"(?m)^Original:\s+([a-f0-9]{40})", 1)
    return F.when(found != "", found)


def model_for_step(step_type: Column | str, default: str = "sonnet", large: str = "opus") -> Column:
    return F.when(_col(step_type).isin("initial-commit", "merge"), large).otherwise(default)


def commit_message(prefix: str, message: Column, sha: Column, original: Column, label: Column, model: Column, kind: str = "Window") -> Column:
    """prefix, blank line, the original commit, its window (or merge) and the model."""
    return F.concat_ws("\n", F.concat(F.lit(f"{prefix}: "), message), F.lit(""), F.concat(F.lit("Original: "), sha, F.lit(' "'), original, F.lit('"')), F.concat(F.lit(f"{kind}: "), label), F.concat(F.lit("Model: "), model))


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def format_duration(seconds: Column | str) -> Column:
    """Ns below a minute, then Nm, Nh or Nh Nm."""
    s = _col(seconds)
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.when(hours == 0, F.concat(minutes, F.lit("m"))).when(minutes == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), minutes, F.lit("m")))
    return F.when(s < 60, F.concat(F.round(s).cast("long"), F.lit("s"))).otherwise(text)


def module_path_error(path: Column | str, ext: str = ".md") -> Column:
    """An error code of a module path; null if it is valid."""
    p = _col(path)
    return F.when(p.startswith("/"), "absolute").when(p.contains(".."), "parent").when(~p.endswith(ext), "extension")
