"""Paths, names, text for embedding, ranges, sizes: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last size of files that are one chunk, and of each step, with the chunk size (fixed values).
WHOLE = 1 << 20
STEPS = ((64 << 20, 1 << 20), (512 << 20, 3 << 19), (None, 2 << 20))
GIB5 = 5 << 30


def normalize(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; null if relative, above the root, or with a NUL."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # The state is the list so far; a null in it stands for a step above the root.
    step = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit(None).cast("string")))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    ok = path.startswith("/") & ~path.contains("\0") & ~F.exists(folded, lambda x: x.isNull())
    return F.when(ok, F.concat(F.lit("/"), F.array_join(folded, "/")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last ``/``, as SQL takes it: of the characters that end a line only a line feed ends the match, where Java's dot stops at others, too."""
    head = F.regexp_extract(path, r"^([^\n]*)/[^/]*$", 1)
    return F.when(head == "", "/").otherwise(head)


def link_target(link: Column, target: Column) -> Column:
    """Where a link points: an absolute target, or one below the link's folder."""
    return normalize(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", dirname(link), target)))


def base64url(data: Column) -> Column:
    """Unpadded base64 for URLs, in one line: Spark breaks the lines of longer ones."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def tokens(text: Column) -> Column:
    """Words of 2 to 39 characters, and the parts of those with ``-``, ``_`` or ``.``."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-_.]", " "), r"\s+"), lambda w: (F.length(w) >= 2) & (F.length(w) < 40))
    own = lambda w: F.when(w.rlike(r"[-_.]"), F.filter(F.split(w, r"[-_.]"), lambda p: F.length(p) > 1)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), own(w))))


def size_word(size: Column) -> Column:
    return F.when(size < 1024, "tiny").when(size < 1 << 20, "small").when(size < 10 << 20, "medium").when(size < 100 << 20, "large").otherwise("very large")


def embedding_text(name: Column, mime: Column, size: Column) -> Column:
    """A file's name without extension as words, its extension, its type's words, and a word for its size."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    words = F.lower(F.regexp_replace(F.regexp_replace(stem, r"([a-z])([A-Z])", "$1 $2"), r"[_\-./]", " "))
    return F.concat_ws(" ", words, F.substring_index(name, ".", -1), F.replace(mime, F.lit("/"), F.lit(" ")), size_word(size), F.lit("file"))


def result_type(mime: Column) -> Column:
    """The first kind whose beginnings or parts the type has (fixed values)."""
    any_of = lambda *parts: mime.rlike("|".join(parts))
    return (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
        .when(any_of("zip", "archive", "tar", "gzip"), "archive")
        .when(any_of("pdf", "text", "document", "spreadsheet", "presentation", "json", "xml", "csv"), "document").otherwise("other")
    )


def size_label(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, half up."""
    one = lambda unit, name: F.concat(F.format_string("%.1f", F.floor(size * 10.0 / unit + 0.5) / 10), F.lit(f" {name}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, one(1 << 10, "KB")).when(size < 1 << 30, one(1 << 20, "MB")).otherwise(one(1 << 30, "GB"))


def extension(name: Column) -> Column:
    """In capitals, six characters at most; FILE without one."""
    found = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(found == "", "FILE").otherwise(F.substring(F.upper(found), 1, 6))


def truncated(name: Column, most: int) -> Column:
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 1), F.lit("…")))


def escaped(text: Column) -> Column:
    """For XML text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def chunk_size(size: Column) -> Column:
    out = F.when(size <= 0, F.lit(0)).when(size <= WHOLE, size)
    for most, step in STEPS:
        out = out.when(size <= most, F.lit(step)) if most else out.otherwise(F.lit(step))
    return out.cast("long")


def chunk_count(size: Column) -> Column:
    cs = chunk_size(size)
    return F.when(cs > 0, F.floor((size + cs - 1) / cs)).otherwise(0).cast("long")


def pool_size(stored: Column) -> Column:
    return (F.lit(32) + F.floor(stored / GIB5)).cast("long")


def backoff(n: Column) -> Column:
    """A minute doubled with each attempt, six hours at most."""
    return F.least(60_000 * F.pow(F.lit(2.0), F.least(n, F.lit(16))), F.lit(21_600_000.0)).cast("long")


def byte_range(header: Column, size: Column) -> Column:
    """An HTTP range as struct(start, end inclusive, status): 206, 416 if unsatisfiable, 200 if absent, malformed or several."""
    first, last = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    a, b = F.try_to_number(first, F.lit("999999999999999999")).cast("long"), F.try_to_number(last, F.lit("999999999999999999")).cast("long")
    ok = header.rlike(r"^bytes=\d*-\d*$") & ((first != "") | (last != "")) & (F.length(first) < 19) & (F.length(last) < 19)
    start = F.when(first == "", F.greatest(size - b, F.lit(0))).otherwise(a)
    end = F.when((first == "") | (last == ""), size - 1).otherwise(F.least(b, size - 1))
    bad = F.when(first == "", (b == 0) | (size == 0)).otherwise((a >= size) | ((last != "") & (b < a)))
    status = F.when(~F.coalesce(ok, F.lit(False)), 200).when((first != "") & (last != "") & (b < a), 200).when(bad, 416).otherwise(206)
    return F.struct(F.when(status == 206, start).alias("start"), F.when(status == 206, end).alias("end"), status.alias("status"))


def fnv(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text, as a signed 32-bit number in a long."""
    mask = F.lit(0xFFFFFFFF)
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(mask)
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda i: F.conv(F.substring(hexed, 4 * i + 1, F.lit(4)), 16, 10).cast("long")
    units = F.transform(F.slice(F.sequence(F.lit(0), F.length(hexed)), F.lit(1), (F.length(hexed) / 4).cast("int")), unit)
    h = F.aggregate(units, F.lit(2166136261).cast("long"), step)
    return F.when(h >= 1 << 31, h - F.lit(1 << 32)).otherwise(h)


def cosine(a: Column, b: Column) -> Column:
    """Of float vectors, in double; 0 for a zero vector, null for unequal lengths."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot / n).otherwise(F.lit(0.0)))


def from_base64url(text: Column) -> Column:
    """The bytes of unpadded base64 for URLs."""
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="))


def big_endian(n: Column, size: int) -> Column:
    """The last bytes of a number, the greatest first, as hexadecimal digits."""
    return F.lpad(F.hex(F.pmod(n, F.lit(1 << (8 * size)))), 2 * size, "0")


def ref_id(path: Column, version: Column) -> Column:
    """The name under which a version refers to its chunks."""
    return F.concat_ws("#", path, version)


def plain_name(text: Column) -> Column:
    """Whether a text may name a tenant or an object."""
    return text.rlike(r"^[A-Za-z0-9._-]{1,128}$")


def variant_key(width: Column, height: Column, fit: Column) -> Column:
    """The key of a variant of any size."""
    return F.concat(F.lit("custom:w"), width.cast("string"), F.lit("h"), height.cast("string"), fit)


def sealed(data: Column, key: Column) -> Column:
    """Bytes sealed with AES-GCM under a nonce of their own hash: nonce, text, tag; equal bytes of one key are sealed alike."""
    nonce = F.substring(F.unhex(F.sha2(F.concat(key, data), 256)), 1, 12)
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("NONE"), nonce)


def opened(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"), F.lit("NONE"))


def upload_backoff(n: Column) -> Column:
    """Milliseconds before the n-th try of an upload again, without the random part."""
    return F.least(100 * F.pow(F.lit(2), n), F.lit(30_000)).cast("long")


def wave_height(width: Column) -> Column:
    """The height of a waveform of a width."""
    return F.floor(width / 4).cast("long")


def code_tokens(text: Column, keywords: str, most: int = 1024) -> Column:
    """Keywords and quoted strings in the beginning of a source text, as a struct of counts; previews show no more of it."""
    head = F.substring(text, 1, most)
    return F.struct(F.size(F.regexp_extract_all(head, F.lit(f"({keywords})"))).cast("long").alias("keywords"), F.size(F.regexp_extract_all(head, F.lit('("[^"]*")'))).cast("long").alias("strings"))


def tags_error(tags: Column, most: int = 32) -> Column:
    """What is wrong with a list of tags: too many, a character or length that is not allowed, or a repeated one; null for what is right."""
    odd = F.exists(tags, lambda t: t.isNull() | ~t.rlike(r"^[A-Za-z0-9._:/-]{1,128}$"))
    return F.when(F.size(tags) > most, "count").when(odd, "tag").when(F.size(F.array_distinct(tags)) < F.size(tags), "repeated")
