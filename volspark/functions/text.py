"""Names, paths, addresses and typed literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def natural_key(name: Column) -> Column:
    """A text whose order is the natural one: before each number stands how many digits it has without leading zeros, letters are lower-case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def flat_key(stem_: Column) -> Column:
    """A stem up to its last underscore."""
    return F.regexp_replace(stem_, "_[^_]*$", "")


def safe_name(path: Column) -> Column:
    """A path as one file name: inner slashes become two underscores, other odd signs one, nothing becomes `root`."""
    inner = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/", "__")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(inner, r"[^A-Za-z0-9_.-]+", "_"), "^_+$", ""), F.lit("")), F.lit("root"))


def padded_name(name: Column, digits: int = 5) -> Column:
    """`a_7.ext` as `a_00007.ext`; a longer number keeps its digits; null unless there is exactly one underscore."""
    m = lambda k: F.regexp_extract(name, r"^([^_]*)_([^_.]*)(\.[^_]*)$", k)
    padded = F.when(F.length(m(2)) >= digits, m(2)).otherwise(F.lpad(m(2), digits, "0"))
    return F.when(name.rlike(r"^[^_]*_[^_.]*\.[^_]*$"), F.concat(m(1), F.lit("_"), padded, m(3)))


def slice_name(prefix: Column, number: Column, digits: int, sep: str = "_z", suffix: str = ".tif") -> Column:
    text = number.cast("string")
    return F.concat(prefix, F.lit(sep), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")), F.lit(suffix))


def without_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def unzipped_name(path: Column) -> Column:
    """Where an unpacked file goes: the name of its directory with the file's last ending but one, or without its only one."""
    parent, name = F.element_at(F.split(path, "/"), -2), F.substring_index(path, "/", -1)
    return F.concat(parent, F.lit("/"), F.regexp_replace(name, r"\.[^.]*$", ""))


def without_zip(name: Column) -> Column:
    return F.regexp_replace(name, r"\.gz$", "")


# addresses ---------------------------------------------------------------------------------------------------------
def layer_address(source: Column) -> Column:
    """`a|b` as `precomputed://a`; others as they are."""
    return F.when(source.contains("|"), F.concat(F.lit("precomputed://"), F.substring_index(source, "|", 1))).otherwise(source)


def layer_path(text: Column) -> Column:
    """Addresses as they are, local paths as file addresses."""
    return F.when(text.contains("://"), text).otherwise(F.concat(F.lit("file://"), text))


def cloud_path(text: Column) -> Column:
    return F.regexp_replace(text, "^precomputed://", "")


def local_path(text: Column) -> Column:
    """The path of a file address or plain path; null for other addresses."""
    plain = cloud_path(text)
    return F.when(plain.startswith("file://"), F.url_decode(F.substring(plain, F.lit(8), F.length(plain)))).when(~plain.contains("://"), plain)


def queue_root(text: Column) -> Column:
    """The hidden queue directory beside a local layer; raises for a remote one."""
    path = F.regexp_replace(local_path(text), "/+$", "")
    name = F.substring_index(path, "/", -1)
    return F.coalesce(F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(name)), F.lit("."), name, F.lit(".queue")), F.raise_error(F.lit("a remote layer needs a queue")).cast("string"))


def bucket_and_key(text: Column) -> Column:
    """struct(bucket, key) of an s3 address; null for others."""
    m = lambda k: F.regexp_extract(cloud_path(text), "^s3://([^/]+)/?(.*)$", k)
    return F.when(m(1) != "", F.struct(m(1).alias("bucket"), m(2).alias("key")))


def join_key(*parts: Column) -> Column:
    """Non-empty parts without outer slashes, joined by slashes."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.regexp_replace(p, "^/+|/+$", "")), lambda p: p != ""), "/")


def endpoint(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def advertised(url: Column, host: str) -> Column:
    """The address with another host, its port kept, an IPv6 host in brackets."""
    shown = f"[{host}]" if ":" in host and not host.startswith("[") else host
    return F.regexp_replace(url, r"^([a-z]+://)(\[[^\]]*\]|[^:/]*)", F.concat(F.lit("$1"), F.lit(shown.replace("$", r"\$"))))


def layer_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("segmentation") | low.contains("labels") | low.endswith("_seg"), "segmentation").otherwise("image")


def layer_encoding(asked: Column, kind: Column, source: Column) -> Column:
    """`auto` is raw for images, a segmentation's compressed form where its source is raw, and else the source's encoding."""
    automatic = F.when(kind == "image", "raw").when((kind == "segmentation") & (source == "raw"), "compressed_segmentation").otherwise(source)
    return F.when(asked != "auto", asked).otherwise(automatic)


def is_color(text: Column) -> Column:
    return text.rlike("^#?([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")


def tagged(name: Column, intensity: Column, radius: Column) -> Column:
    return F.concat(name, F.lit(" ID"), intensity.cast("string"), F.lit("r"), radius.cast("string"))


# typed literals ----------------------------------------------------------------------------------------------------
def option_map(text: Column) -> Column:
    """`k=v,k=v` as a map, the last of equal keys winning."""
    pairs = F.transform(F.split(text, ","), lambda p: F.split(p, "=", 2))
    return F.map_from_entries(F.transform(F.map_keys(F.map_from_arrays(F.array_distinct(F.transform(pairs, lambda p: p[0])), F.array_distinct(F.transform(pairs, lambda p: p[0])))), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p[0] == k), -1)[1])))


def number_range(text: Column, kind: str = "int") -> Column:
    """`stop`, `start,stop` or `start,stop,step` as struct(start, stop, step)."""
    p = F.split(text, ",")
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast(kind)
    one = F.size(p) == 1
    return F.struct(F.when(one, F.lit(0).cast(kind)).otherwise(at(1)).alias("start"), F.when(one, at(1)).otherwise(at(2)).alias("stop"), F.coalesce(at(3), F.lit(1).cast(kind)).alias("step"))


def record(text: Column, fields: list[tuple[str, str, object]], sep: str = ":") -> Column:
    """A delimited record; missing and empty fields take their defaults. fields: name, type, default."""
    p = F.split(text, sep)
    return F.struct(*[F.coalesce(F.nullif(F.try_element_at(p, F.lit(i + 1)), F.lit("")).try_cast(kind), F.lit(default).cast(kind)).alias(n) for i, (n, kind, default) in enumerate(fields)])


def crop_pair(text: Column) -> Column:
    """One or two crop amounts as struct(first, last, voxels): all digits mean voxels, else fractions."""
    p = F.transform(F.split(text, ","), lambda t: F.trim(t))
    whole = F.forall(p, lambda t: t.rlike("^[0-9]+$"))
    return F.struct(F.get(p, F.lit(0)).try_cast("double").alias("first"), F.get(p, F.size(p) - 1).try_cast("double").alias("last"), whole.alias("voxels"))


def triple(text: Column) -> Column:
    """`a,b,c` or `axbxc` as three integers; null if there are not three."""
    p = F.transform(F.split(text, "[x,]"), lambda t: F.trim(t).try_cast("int"))
    return F.when((F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull()), p)


def slices(text: Column) -> Column:
    """`[a:b:c,d:e]` as an array of struct(start, stop, step), missing numbers null."""
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")

    def one(t: Column) -> Column:
        p = F.split(t, ":")
        at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
        return F.struct(at(1).alias("start"), at(2).alias("stop"), at(3).alias("step"))

    return F.transform(parts, one)


def byte_size(text: Column) -> Column:
    """A decimal number and B, KiB, MiB, GiB or TiB in bytes; null for anything else."""
    m = lambda k: F.regexp_extract(F.trim(text), r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(B|KiB|MiB|GiB|TiB)?$", k)
    power = F.array_position(F.array(*[F.lit(u) for u in ("kib", "mib", "gib", "tib")]), F.lower(m(2)))
    unit = F.element_at(F.array(*[F.lit(1 << 10 * k) for k in range(5)]), (power + 1).cast("int"))
    return F.floor(F.nullif(m(1), F.lit("")).try_cast("decimal(20,6)") * unit.cast("decimal(15,0)")).cast("bigint")


def mip_list(text: Column) -> Column:
    """Sorted distinct levels; null if one isn't a number."""
    p = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("int"))
    return F.when(F.forall(p, lambda v: v.isNotNull() & (v >= 0)), F.array_sort(F.array_distinct(p)))


def type_list(text: Column, known: list[str]) -> Column:
    """Distinct type names in order; null if one is unknown."""
    p = F.array_distinct(F.transform(F.split(text, ","), lambda t: F.trim(t)))
    return F.when(F.size(F.array_except(p, F.array(*[F.lit(k) for k in known]))) == 0, p)


def node_list(lists: Column) -> Column:
    """Comma lists flattened, in order of first sight."""
    names = F.flatten(F.transform(lists, lambda t: F.transform(F.split(t, ","), lambda n: F.trim(n))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def key_values(text: Column) -> Column:
    """Lines of a key and a number as a map; lines without a number are left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t: F.split(F.trim(t), r":?\s+")), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(1)).try_cast("bigint").isNotNull())
    return F.map_from_entries(F.transform(lines, lambda p: F.struct(p[0], p[1].try_cast("bigint"))))


# time, units, fingerprints ------------------------------------------------------------------------------------------
def iso_nanos(seconds: Column, nanos: Column) -> Column:
    """Epoch seconds and nanoseconds as ISO text with nine decimals."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"), F.lit("Z"))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit below them, with two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * k, F.concat(F.format_string("%.2f", F.bround(n / float(1 << 10 * k), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def fingerprint(*values: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the values' JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*values)), 256), 1, 16)


def status_text(name: Column) -> Column:
    """`FLATS_GENERATED_UC` as `Flats Generated Uc`."""
    return F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def log_time(line: Column) -> Column:
    """The time that the last 26 signs of a log line state; null if they state none."""
    return F.try_to_timestamp(F.substring(F.rtrim(line), F.length(F.rtrim(line)) - 25, F.lit(26)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def value_text(value: Column, most: int = 64) -> Column:
    """An array of one as its value, a longer one as a list, one of more than `most` by its size."""
    return F.when(F.size(value) == 1, value[0].cast("string")).when(F.size(value) > most, F.concat(F.lit("<"), F.size(value).cast("string"), F.lit(" values>"))).otherwise(F.concat(F.lit("["), F.concat_ws(", ", value.cast("array<string>")), F.lit("]")))
