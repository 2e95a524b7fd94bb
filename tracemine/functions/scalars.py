"""Functions of columns: locations, label sets, byte runs, magic values, names. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemine.schemas import EXTRA_DUAS, MAGIC, PADS

LOC_TYPE = "struct<filename:string,begin_line:int,begin_column:int,end_line:int,end_column:int>"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_ast_loc(s, strict: bool = False) -> Column:
    """``bl:bc:el:ec:file`` as a struct; the file name may hold colons. Fewer than five parts, or no numbers, give null, or an error if strict."""
    s = _col(s)
    parts = F.split(s, ":", 5)
    ok = s.rlike(r"(?s)^\s*\d+\s*:\s*\d+\s*:\s*\d+\s*:\s*\d+\s*:.*$")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    loc = F.struct(F.get(parts, F.lit(4)).alias("filename"), number(0).alias("begin_line"), number(1).alias("begin_column"), number(2).alias("end_line"), number(3).alias("end_column"))
    bad = F.raise_error(F.concat(F.lit("no location: "), s)).cast(LOC_TYPE) if strict else F.lit(None).cast(LOC_TYPE)
    return F.when(s.isNull(), F.lit(None).cast(LOC_TYPE)).when(ok, loc).otherwise(bad)


def format_ast_loc(loc) -> Column:
    loc = _col(loc)
    return F.concat_ws(":", *(loc[k].cast("string") for k in ("begin_line", "begin_column", "end_line", "end_column")), loc["filename"])


def is_header_file(name) -> Column:
    """Names that end in ``.h``; shorter ones than two characters count as headers."""
    name = _col(name)
    return (F.length(name) < 2) | name.endswith(".h")


def parse_c_int(s) -> Column:
    """An integer as C writes it: 0x hex, a leading 0 octal, else decimal; null if it is none. Bit patterns from 2**63 on become negative."""
    s = F.lower(F.trim(_col(s)))
    body = F.regexp_replace(s, "^[+-]", "")
    sign = F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    wide = lambda digits, base: F.conv(digits, base, -10).cast("bigint")
    value = F.when(body.rlike("^0x[0-9a-f]{1,16}$"), wide(F.substring(body, 3, 16), 16)).when(body.rlike("^0[0-7]+$"), wide(body, 8)).when(body.rlike("^[0-9]+$"), F.coalesce(body.try_cast("bigint"), wide(body, 10)))
    return F.when(sign < 0, F.negate(value)).otherwise(value)


def basename(path) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def disjoint(a, b) -> Column:
    """Whether two label sets share nothing; nulls are empty sets."""
    none = F.array().cast("array<int>")
    return ~F.arrays_overlap(F.coalesce(_col(a), none), F.coalesce(_col(b), none))


def merge_labels(*sets) -> Column:
    """The sorted union of label sets; nulls are empty sets."""
    none = F.array().cast("array<int>")
    out = F.coalesce(_col(sets[0]), none)
    for s in sets[1:]:
        out = F.array_union(out, F.coalesce(_col(s), none))
    return F.sort_array(F.array_distinct(out))


def merged_labels(labels) -> Column:
    """Aggregate: the sorted set of an exploded label column."""
    return F.sort_array(F.collect_set(_col(labels)))


def count_viable(values) -> Column:
    return F.size(F.filter(_col(values), lambda x: x.isNotNull()))


def range_size(r) -> Column:
    return _col(r)["high"] - _col(r)["low"]


def range_empty(r) -> Column:
    return _col(r)["high"] <= _col(r)["low"]


def _range(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def first_dead_run(ok, n: int = MAGIC) -> Column:
    """The first n consecutive true bytes as a range, else [0, 0). Null bytes are false."""
    ok = _col(ok)
    starts = F.when(F.size(ok) >= n, F.sequence(F.lit(0), F.size(ok) - n)).otherwise(F.array().cast("array<int>"))
    hit = F.get(F.filter(starts, lambda i: F.forall(F.slice(ok, i + 1, F.lit(n)), lambda x: F.coalesce(x, F.lit(False)))), F.lit(0))
    return F.when(hit.isNull(), _range(F.lit(0), F.lit(0))).otherwise(_range(hit, hit + n))


def _longest(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit(0).alias("low"), F.lit(0).alias("high"))

    def step(s, ok):
        begin, after = F.when(ok, s["from"]).otherwise(s["at"] + 1), s["at"] + 1
        longer = ok & (after - begin > s["high"] - s["low"])
        return F.struct(after.alias("at"), begin.alias("from"), F.when(longer, begin).otherwise(s["low"]).alias("low"), F.when(longer, after).otherwise(s["high"]).alias("high"))

    return F.aggregate(flags, start, step, lambda s: _range(s["low"], s["high"]))


def longest_run(values) -> Column:
    """The longest run of bytes that are not null; of equal ones the first; [0, 0) if there is none."""
    return _longest(F.transform(_col(values), lambda x: x.isNotNull()))


def first_run_at_least(values, n: int) -> Column:
    """The first n bytes of the first run of at least n bytes that are not null, else [0, 0)."""
    return first_dead_run(F.transform(_col(values), lambda x: x.isNotNull()), n)


def exploit_pad(n_labels, tcn, liveness, need: int = 20, most_live: int = 10) -> Column:
    """The longest run of bytes with one label, tcn 0 and a liveness of ``most_live`` at most (arrays by byte); its first four bytes are left out if it has ``need``."""
    flags = F.zip_with(F.zip_with(_col(n_labels), _col(tcn), lambda a, b: (a == 1) & (b == 0)), _col(liveness), lambda a, b: F.coalesce(a & (b <= most_live), F.lit(False)))
    r = _longest(flags)
    return _range(F.when(r["high"] - r["low"] >= need, r["low"] + MAGIC).otherwise(r["low"]), r["high"])


def labels_in_range(byte_labels, low, high) -> Column:
    """The sorted union of the label arrays of bytes [low, high)."""
    part = F.slice(_col(byte_labels), _col(low) + 1, F.greatest(F.lit(0), _col(high) - _col(low)))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(part, lambda x: x.isNotNull()))))


def callee_function(caller) -> Column:
    """What follows the first ``!``; null without one."""
    return F.get(F.split(_col(caller), "!", 3), F.lit(1))


def _byte_of(key: Column, seed, i: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 2 * i + 1, 2), 16, 10).cast("int")


def magic_value(key, seed=0) -> Column:
    """A 32-bit value of four letters, each a byte from 0x60 to 0x79 whose case bit may be cleared, drawn from md5(seed:key)."""
    key, out = _col(key), F.lit(0).cast("bigint")
    for i in range(MAGIC):
        letter = F.lit(0x60) + _byte_of(key, seed, i) % 26 - F.when(_byte_of(key, seed, i + MAGIC) % 2 == 1, 0x20).otherwise(0)
        out = out * 256 + letter
    return out


def magic_kt(magic) -> Column:
    return _col(magic).bitwiseAND(F.lit(0xFFFF))


def pack_le32(n) -> Column:
    """The low 32 bits as four bytes, the lowest first."""
    h = F.lpad(F.hex(_col(n).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, 7 - 2 * i, 2) for i in range(4))))


def knob_value(magic, knob: int) -> Column:
    """A trigger value that carries a knob in its upper half."""
    return F.lit(knob << 16).cast("bigint").bitwiseOR(magic_kt(magic))


def file_suffix(name) -> Column:
    """The extension with its dot; empty without one."""
    return F.regexp_extract(_col(name), r"[^.](\.[^.]*)$", 1)


def fuzzed_name(name, bug_id) -> Column:
    name = _col(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(name)))
    return F.concat(stem, F.lit("-fuzzed-"), _col(bug_id).cast("string"), file_suffix(name))


def lval_members(ast_name) -> Column:
    """The names along an lvalue such as ``((*p).a).b``, in order."""
    return F.regexp_extract_all(_col(ast_name), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def _lookup(kind, values: dict) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(_col(kind) == k, v).otherwise(out)
    return out


def extra_dua_arity(kind) -> Column:
    return _lookup(kind, EXTRA_DUAS)


def pad_requirement(kind) -> Column:
    """Bytes of padding; 0 for kinds without."""
    return F.coalesce(_lookup(kind, PADS), F.lit(0))


def path_value(path) -> Column:
    """A path of L and R as the number whose bits it spells; null for anything else."""
    path = _col(path)
    return F.when(path.rlike("^[LR]{1,63}$"), F.conv(F.translate(path, "LR", "01"), 2, 10).cast("bigint"))
