"""Archives: entries of zip, tar and gzip files, safe and unique names, manifests and repackaging."""

from __future__ import annotations

import bz2
import datetime
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as X
from sheafline.plans.rows import CodedError, explode_rows

MOST_BYTES = 300 << 20
ENTRY = "entry_pos int, entry string, is_dir boolean, size long, compressed_size long, crc32 long, mtime timestamp, bytes binary, reencoded boolean"


def unique_names(df: DataFrame, name: str, order: str, *scope: str) -> DataFrame:
    """df with unique_name: the k-th of equal names gets -k before its extension, past numbers that other names have taken."""
    stem, ext = X.base_name(name), X.ext_of(name)
    nth = F.row_number().over(W.partitionBy(*scope, name).orderBy(order)) - 1
    named = df.withColumns({"__k": nth, "__stem": stem, "__ext": ext})
    number = F.regexp_extract("__stem", r"^(.*)-([0-9]{1,6})$", 2)
    taken = named.where(number != "").select(*scope, F.regexp_extract("__stem", r"^(.*)-([0-9]{1,6})$", 1).alias("__stem"), "__ext", number.cast("int").alias("__taken"))
    taken = taken.groupBy(*scope, "__stem", "__ext").agg(F.collect_set("__taken").alias("__taken"))
    both = named.join(taken, [*scope, "__stem", "__ext"], "left")
    used = F.coalesce("__taken", F.array().cast("array<int>"))
    free = F.try_element_at(F.array_except(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__k") + F.size(used))), used), F.greatest(F.lit(1), F.col("__k")))
    free = F.when(F.size(used) == 0, F.col("__k")).otherwise(free)
    tail = F.when(F.col("__ext") == "", F.lit("")).otherwise(F.concat(F.lit("."), F.col("__ext")))
    out = F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat("__stem", F.lit("-"), free.cast("string"), tail))
    return both.withColumn("unique_name", out).drop("__k", "__stem", "__ext", "__taken")


def is_hidden(entry: Column | str) -> Column:
    """Whether a segment of the path starts with a dot (`.` and `..` aside)."""
    e = F.col(entry) if isinstance(entry, str) else entry
    return F.exists(F.split(e, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def output_name(entry: Column | str, flat: bool = False) -> Column:
    """Where an entry may be written: no segment leads out; flat names join their segments by underscores."""
    safe = X.safe_path(entry)
    return F.replace(safe, F.lit("/"), F.lit("_")) if flat else safe


def _name(raw: str, flags: int) -> tuple[str, bool]:
    """Names that zip files hold without the UTF-8 flag, as UTF-8 or else GBK."""
    if flags & 0x800 or raw.isascii():
        return raw, False
    data = raw.encode("cp437", "replace")
    for code in ("utf-8", "gb18030"):
        try:
            return data.decode(code), True
        except UnicodeDecodeError:
            continue
    return raw, False


def _zip(data: bytes, most: int, content: bool) -> list[tuple]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if content and sum(i.file_size for i in infos) > most:
            raise CodedError("ARCHIVE_TOO_LARGE", f"its entries hold more than {most} bytes")
        for n, i in enumerate(infos, 1):
            name, fixed = _name(i.filename, i.flag_bits)
            try:
                when = datetime.datetime(*i.date_time)
            except ValueError:
                when = None
            body = None if i.is_dir() or not content else z.read(i)
            out.append((n, name.replace("\\", "/"), i.is_dir(), len(body) if body is not None else i.file_size, i.compress_size, i.CRC, when, body, fixed))
    return out


def _tar(data: bytes, most: int, content: bool) -> list[tuple]:
    out, total = [], 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if not (m.isfile() or m.isdir()):
                continue
            total += m.size
            if content and total > most:
                raise CodedError("ARCHIVE_TOO_LARGE", f"its entries hold more than {most} bytes")
            body = t.extractfile(m).read() if m.isfile() and content else None
            when = datetime.datetime.fromtimestamp(m.mtime, datetime.timezone.utc).replace(tzinfo=None)
            out.append((len(out) + 1, m.name, m.isdir(), m.size, m.size, zlib.crc32(body) if body is not None else None, when, body, False))
    return out


def entries_of(data: bytes | None, name: str = "", most: int = MOST_BYTES, content: bool = True) -> list[tuple]:
    """Entries of a zip, tar, compressed tar or gzip file, in order."""
    data = data or b""
    if not data:
        raise CodedError("ARCHIVE_EMPTY", "there is no byte")
    try:
        if data[:2] == b"PK":
            return _zip(data, most, content)
        if data[257:262] == b"ustar":
            return _tar(data, most, content)
        if data[:2] == b"\x1f\x8b":
            with gzip.open(io.BytesIO(data)) as f:
                body = f.read(most + 1)
            if len(body) > most:
                raise CodedError("ARCHIVE_TOO_LARGE", f"it holds more than {most} bytes")
            if body[257:262] == b"ustar":
                return _tar(body, most, content)
            inner = name.rpartition("/")[2]
            inner = inner[:-3] if inner.lower().endswith(".gz") else inner or "data"
            if data[3] & 8 and not data[3] & 4:
                inner = data[10 : data.index(b"\0", 10)].decode("utf-8", "replace") or inner
            when = int.from_bytes(data[4:8], "little")
            stamp = datetime.datetime.fromtimestamp(when, datetime.timezone.utc).replace(tzinfo=None) if when else None
            return [(1, inner, False, len(body), len(data), zlib.crc32(body), stamp, body if content else None, False)]
        return _tar(data, most, content)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, NotImplementedError, RuntimeError) as e:
        raise CodedError("ARCHIVE_READ_FAILED", str(e)) from e


def entries(df: DataFrame, content: str = "content", name: str = "name", most: int = MOST_BYTES, mode: str = "PERMISSIVE") -> DataFrame:
    """One row for each entry of each archive: see ENTRY; an archive that cannot be read has one row with its error."""
    keep = [c for c in df.columns if c != content]
    return explode_rows(df, lambda b, n: entries_of(b, n or "", most), [content, name], ENTRY, keep, mode)


def visible(found: DataFrame, hidden: bool = False) -> DataFrame:
    """Files, hidden ones only if asked for."""
    files = found.where("error_code is null and not is_dir")
    return files if hidden else files.where(~is_hidden("entry"))


def manifest(found: DataFrame, *key: str) -> DataFrame:
    """key, n_entries, total_size, n_hidden, listing: a line an entry in order, and totals."""
    files = found.where("error_code is null and not is_dir").withColumn("__hidden", is_hidden("entry"))
    line = F.concat(F.rpad(F.substring("entry", 1, 48), 48, " "), F.lit("  "), F.lpad(X.format_bytes("size"), 10, " "), F.lit("  "), F.coalesce(F.lpad(F.lower(F.hex("crc32")), 8, "0"), F.lit("-")))
    shown = files.withColumn("__line", line).where("not __hidden").groupBy(*key).agg(
        F.expr("listagg(__line, '\\n') WITHIN GROUP (ORDER BY entry_pos)").alias("listing"), F.count("*").cast("long").alias("n_entries"), F.sum("size").alias("total_size")
    )
    hidden = files.groupBy(*key).agg(F.count_if("__hidden").cast("long").alias("n_hidden"))
    return hidden.join(shown, list(key), "left").select(*key, F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("total_size", F.lit(0).cast("long")).alias("total_size"), "n_hidden", F.coalesce("listing", F.lit("")).alias("listing"))


def pack(files: list[tuple[str, bytes]], kind: str = "zip") -> bytes:
    """A zip or tar file of names and bytes; the same input gives the same bytes."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for name, body in files:
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, body)
    elif kind == "tar":
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, body in files:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    elif kind == "tgz":
        return gzip.compress(pack(files, "tar"), mtime=0)
    elif kind == "gz":
        if len(files) != 1:
            raise CodedError("ARCHIVE_UNSUPPORTED_FORMAT", f"gz holds one file, not {len(files)}")
        return gzip.compress(files[0][1], mtime=0)
    else:
        raise CodedError("ARCHIVE_UNSUPPORTED_FORMAT", f"cannot write {kind}")
    return out.getvalue()


def manifest_json(found: DataFrame, *key: str, name: str = "name") -> DataFrame:
    """key, manifest: a JSON object with the file's name, counts, the sum of sizes, and an object for each visible entry; names,
    sizes, times (ISO, UTC) and checksums as hex."""
    files = found.where("error_code is null and not is_dir").withColumn("__hidden", is_hidden("entry"))
    iso = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.struct(F.col("entry_pos"), F.col("entry").alias("name"), "size", F.col("compressed_size").alias("compressedSize"), iso.alias("modified"), F.upper(F.lpad(F.hex("crc32"), 8, "0")).alias("crc32"))
    rows = files.groupBy(*key).agg(
        F.first(name).alias("file"), F.count_if(~F.col("__hidden")).cast("long").alias("entryCount"), F.coalesce(F.sum(F.when(~F.col("__hidden"), F.col("size"))), F.lit(0)).cast("long").alias("totalSize"),
        F.count_if("__hidden").cast("long").alias("hiddenSkipped"), F.array_sort(F.collect_list(F.when(~F.col("__hidden"), entry))).alias("entries"),
    )
    slim = F.transform("entries", lambda e: e.dropFields("entry_pos"))
    return rows.select(*key, F.to_json(F.struct("file", "entryCount", "totalSize", "hiddenSkipped", slim.alias("entries")), {"ignoreNullFields": "false"}).alias("manifest"))


def repackage(df: DataFrame, content: str = "content", name: str = "name", kind: str = "zip", hidden: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """df with packed: each archive's visible files in a new one."""
    from sheafline.plans.rows import map_rows

    def run(data, label):
        files = [(e[1], e[7]) for e in entries_of(data, label or "") if not e[2] and (hidden or not any(s.startswith(".") and s not in (".", "..") for s in e[1].split("/")))]
        return (pack(files, kind),)

    return map_rows(df, run, [content, name], "packed binary", mode=mode)


def bundles(files: DataFrame, *key: str, name: str = "name", content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """key, bundle, n_files: one zip file for each key.  A key's files must fit in `most` bytes; larger keys have a null bundle."""
    sized = files.groupBy(*key).agg(F.sum(F.octet_length(content)).alias("__size"))
    small = files.join(sized.where(F.col("__size") <= most).drop("__size"), list(key), "left_semi")
    rows = small.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(content).alias("content")))).alias("__files"))
    from sheafline.plans.rows import map_rows

    got = map_rows(rows, lambda fs: (pack([(f["name"], f["content"] or b"") for f in fs]), len(fs)), ["__files"], "bundle binary, n_files long", keep=list(key))
    return sized.select(*key).join(got, list(key), "left")


DECOMPRESSORS = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}
