"""String columns: names, paths, escaping, inline markup, failure wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted file name endings.
STANDARD_EXTS = (".svs", ".tif", ".tiff", ".ndpi")
MIRAX_EXTS = (".mrxs", ".mrsx")
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def safe_filename(text: Column, longest: int = 64) -> Column:
    """Letters, digits, - and _ stay, white space becomes _, other characters go; no _ at the ends; `tile` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s", "_")
    kept = F.regexp_replace(F.regexp_replace(kept, r"[^\p{L}\p{N}_-]", ""), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, longest), F.lit("")), F.lit("tile"))


def extension(path: Column) -> Column:
    """From the last dot of the last path part on, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def is_safe_relative(path: Column) -> Column:
    """Neither absolute nor with a .. part."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def is_within(path: Column, base: Column | str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return path.startswith(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")))


def public_url(path: Column, root: str, prefix: str = "/debug/") -> Column:
    """The address of a file below root, null for others."""
    root = root if root.endswith("/") else root + "/"
    return F.when(path.startswith(root), F.concat(F.lit(prefix), F.replace(F.substring(path, len(root) + 1, 1 << 20), F.lit("\\"), F.lit("/"))))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


#: Inline marks and what they become, in order.
INLINE = (
    (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", '<a href="$2" target="_blank" rel="noreferrer">$1</a>'),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
    (r"__([^_]+)__", "<strong>$1</strong>"),
    (r"\*([^*]+)\*", "<em>$1</em>"),
    (r"_([^_]+)_", "<em>$1</em>"),
)


def inline_html(text: Column) -> Column:
    out = escape_html(text)
    for pattern, shown in INLINE:
        out = F.regexp_replace(out, pattern, shown)
    return out


#: Wordings of a final text that tell of a failure.
FAILURES = (
    "unable to (load|open|process|read|view|access)",
    "cannot (load|open|process|read|view|access)",
    "could not (load|open|process|read|view|access)",
    "failed to (load|open|process|read|view|access)",
    "no slide (found|available|provided|loaded)",
    "slide (not found|could not be loaded|failed to load)",
    "file not found",
    "image (not|could not be|was not) (found|loaded|processed|provided)",
    "error (loading|opening|reading) (the |this )?(slide|image|file)",
)
FATAL = ("unsupported or missing image file", "openslideunsupportedformaterror")


def tells_failure(text: Column) -> Column:
    """Any of the wordings, whatever the case. Each starts with plain words; only texts that hold some of these meet the expressions."""
    low, hint = F.lower(text), F.lit(False)
    for pattern in FAILURES:
        hint = hint | low.contains(pattern.partition("(")[0])
    return F.coalesce(hint & text.rlike("(?i)" + "|".join(f"(?:{p})" for p in FAILURES)), F.lit(False))


def is_fatal(text: Column) -> Column:
    found = F.lit(False)
    for wording in FATAL:
        found = found | F.lower(text).contains(wording)
    return F.coalesce(found, F.lit(False))


def effective_status(status: Column, final_text: Column) -> Column:
    """`done` with a text that tells of a failure is `done-warn`."""
    return F.when((status == "done") & tells_failure(final_text), "done-warn").otherwise(status)


def is_busy(status: Column) -> Column:
    return status.isin("created", "uploading", "pending", "running")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def data_url(content: Column, path: Column) -> Column:
    """data:<type>;base64,...; the type by file ending, image/jpeg if unknown."""
    ext = extension(path)
    kind = F.when(ext == ".png", "image/png").when(ext == ".gif", "image/gif").when(ext == ".webp", "image/webp").when(ext == ".bmp", "image/bmp").when(ext.isin(".tif", ".tiff"), "image/tiff").otherwise("image/jpeg")
    # base64 of long content carries no line breaks in a data URL
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def run_id(when: Column, token: Column) -> Column:
    """Time of creation to the second and six hexadecimal digits."""
    return F.concat(F.date_format(when, "yyyyMMdd_HHmmss_"), F.substring(token, 1, 6))


def params_hash(*params: Column) -> Column:
    """SHA-256 of the parameters as JSON with sorted keys; every parameter belongs to it."""
    return F.sha2(F.to_json(F.struct(*params)), 256)
