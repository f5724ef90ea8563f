"""Column functions on addresses, names, descriptions and log values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address map of the two-processor controller.
BANK_SPLIT = 0x8000
SLAVE_OFFSET = 0x88000
CAL_REGIONS = [("cal", 0x88000, 0x8FFFF), ("rawcal", 0x8000, 0xFFFF), ("code", 0x10000, 0x7FFFF), ("ram", 0xFF0000, 0xFFFFFFFF), ("boot", 0x0, 0x7FFF)]
#: Names that a disassembler makes up.
AUTO_PREFIXES = ("FUN_", "DAT_", "LAB_", "SUB_", "UNK_", "SWITCH_", "caseD_")
#: What an editor's stamp in a description has.
STAMP = r"\bHW:\d|MatchRatio|BlockFound|Created by find routine|File Orientation"


def bank_of(addr: Column) -> Column:
    return F.when(addr < BANK_SPLIT, "slave").otherwise("master")


def file_offset(addr: Column) -> Column:
    return F.when(addr < BANK_SPLIT, addr + SLAVE_OFFSET).otherwise(addr)


def program_address(addr: Column) -> Column:
    return F.lit(SLAVE_OFFSET) + addr % BANK_SPLIT


def region_of(addr: Column, regions=CAL_REGIONS) -> Column:
    """The first range that holds the address, else 'other'."""
    return F.coalesce(*(F.when(addr.between(lo, hi), F.lit(name)) for name, lo, hi in regions), F.lit("other"))


def node_id(kind: str, *parts: Column) -> Column:
    forms = {"param": "p:%05x", "func": "f:%s:%06x", "ram": "r:%s:%06x", "frpage": "d:%s:%d", "unknown": "u:%s"}
    return F.format_string(forms[kind], *parts)


def bilingual(name: Column) -> Column:
    """'German (English)' as a struct de, en; without brackets both are the name."""
    inner = F.regexp_extract(name, r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    outer = F.regexp_extract(name, r"^(.*?)\s*\(([^()]*)\)\s*$", 1)
    return F.struct(F.when(inner == "", F.trim(name)).otherwise(outer).alias("de"), F.when(inner == "", F.trim(name)).otherwise(F.trim(inner)).alias("en"))


def base_name(name: Column) -> Column:
    """The name without one trailing group in brackets."""
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))


def name_shape(token: Column, mnemonic: str = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$", signal: str = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$", least: int = 4) -> Column:
    """'mnemonic', 'signal' or null."""
    auto = F.lit(False)
    for p in AUTO_PREFIXES:
        auto = auto | token.startswith(p)
    ok = (F.length(token) >= least) & ~auto
    return F.when(ok & token.rlike(mnemonic), "mnemonic").when(ok & token.rlike(signal), "signal")


def confidence(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "documented").otherwise("derived")


def category_ids(members: Column) -> Column:
    """Sorted distinct category numbers: members hold them decimal and one too high."""
    return F.array_sort(F.array_distinct(F.transform(members, lambda x: x - 1)))


def hex_index(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def description_address(desc: Column, digits: int = 6) -> Column:
    """The hex address of at most ``digits`` digits on the first line 'NAME HEX', or null."""
    found = F.regexp_extract(F.get(F.split(desc, "\n"), F.lit(0)), rf"^\S+\s+(?:0x)?([0-9A-Fa-f]{{2,{digits}}})\s*$", 1)
    return F.when(found != "", F.conv(found, 16, 10).cast("long"))


def address_mismatch(desc: Column, owned: Column, digits: int = 6) -> Column:
    stated = description_address(desc, digits)
    return F.coalesce(stated.isNotNull() & ~F.array_contains(owned, stated), F.lit(False))


def description_body(desc: Column) -> Column:
    return F.trim(F.regexp_replace(desc, r"^[^\n]*\n?", ""))


def is_tool_metadata(desc: Column, pattern: str = STAMP) -> Column:
    return F.coalesce(desc.rlike(pattern), F.lit(False))


def meaningful_description(first: Column, second: Column) -> Column:
    """The first language's text, else the second's; null if it is empty or a stamp."""
    text = F.coalesce(first, second)
    return F.when((text != "") & ~is_tool_metadata(text), text)


def short_gloss(desc: Column, most: int = 40) -> Column:
    s = F.trim(F.get(F.split(desc, r"[.。\n]"), F.lit(0)))
    return F.when((s != "") & (F.length(s) <= most), s)


def display_name(name: Column, kind: Column) -> Column:
    return F.when((kind != "func") & name.rlike("^[A-Za-z0-9_]+$"), F.upper(name)).otherwise(name)


def excerpt(text: Column, most: int = 600) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def alternatives(token: Column) -> Column:
    """'{A | B}' as an array; a plain token as itself."""
    inner = F.regexp_extract(token, r"^\{\s*(.*?)\s*\}$", 1)
    return F.when(inner != "", F.split(inner, r"\s*\|\s*")).otherwise(F.array(token))


def kind_by_prefix(name: Column) -> Column:
    """What the naming scheme says of a name that no table knows; case matters for signals only."""
    prefix = lambda p: name.rlike(f"(?i)^{p}_")
    return F.when(prefix("KF"), "map").when(prefix("KL"), "curve").when(prefix("K"), "constant").when(name.rlike("^[A-Z][A-Z0-9_]*$"), "signal").otherwise("unknown")


#: Literals, a decompiler's pseudo-operations and its unnamed addresses and parameters.
SYMBOL_NOISE = r"^(?:0x[0-9a-fA-F]+|\d+|CONCAT\d+|SUB\d+|SCARRY\d+|ZEXT\d+|SEXT\d+|abs|(?:DAT|UNK|PTR)_[0-9a-fA-F]{6,8}|param_\d+)$"
#: Interpolations, filters and memory helpers.
HELPER = r"^(?:(?:kf|kl)[su]_[wb]int$|(?:PT1|IIR)_Filter_\w+$|mem(?:cpy|set|move)|tableLookup$)"
#: Names that a decompiler gives to locals, registers and returns.
TEMPORARY = r"^(?:[a-z]{1,2}Var\d+$|local_[0-9a-f]+$|[a-z]Stack_[0-9a-f]+$|p[A-Z]?\w*Var\d+$|unaff_|in_|extraout_|__)"


def is_symbol_noise(name: Column) -> Column:
    return (F.length(name) < 2) | name.rlike(SYMBOL_NOISE)


def is_helper(name: Column) -> Column:
    return name.rlike(HELPER)


def is_temporary(name: Column) -> Column:
    return name.rlike(TEMPORARY)


def helper_class(name: Column) -> Column:
    """shape, signed and width (0 without one) of an interpolation helper, and the kind of a filter; all null for other names."""
    part = lambda i: F.regexp_extract(name, r"^k([fl])([su])_([wb])int$", i)
    kind = F.nullif(F.regexp_extract(name, r"^(PT1|IIR)_Filter_\w+$", 1), F.lit(""))
    shape = F.when(part(1) == "f", "map").when(part(1) == "l", "curve").when(name == "tableLookup", "table").when(kind.isNotNull(), "filter")
    width = F.when(part(3) == "w", 16).when(part(3) == "b", 8).when(shape.isNotNull(), 0)
    return F.struct(shape.alias("shape"), F.when(shape.isNotNull(), part(2) == "s").alias("signed"), width.alias("width"), kind.alias("kind"))


def out_name(out: Column) -> Column:
    return F.regexp_replace(out, r"[\[\].>-].*$", "")


def localised(lang: Column, de: Column, en: Column, ja: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(lang == "ja", full(ja)), full(en), full(de), full(ja), F.lit(""))


def decode_channel(raw: Column, scale: Column, add: Column) -> Column:
    return raw * scale + add


def resign(value: Column, top: float = 3276.7, span: float = 6553.6) -> Column:
    return F.when(value > top, value - span).otherwise(value)


def quantise_gradient(dn: Column, step: int = 40, most: int = 127) -> Column:
    """Steps of ``step`` rounded half a step up and then towards zero, clamped."""
    q = ((dn + step // 2) / step).cast("int")
    return F.greatest(F.lit(-most), F.least(F.lit(most), q))


def wire_time_ms(payload: Column, overhead: int = 9, per_byte: float = 1.14583) -> Column:
    return (payload + overhead) * per_byte


def refresh_hz(total_wire_ms: Column) -> Column:
    """Rate of blocks that are polled in turn, from the sum of their wire times."""
    return F.try_divide(F.lit(1000.0), total_wire_ms)


def segment_time_us(n: Column) -> Column:
    return F.try_divide(F.lit(20e6), n)


def percent_to_us(pct: Column, n: Column) -> Column:
    return pct / 100 * segment_time_us(n)


def us_to_percent(us: Column, n: Column) -> Column:
    return F.try_divide(us * 100, segment_time_us(n))


def relative_filling(ml: Column, n: Column, factor: float = 0.1091) -> Column:
    """Filling from air mass in kg/h and speed."""
    return F.try_divide(ml, n * factor)


def air_mass(rf: Column, n: Column, factor: float = 0.1091) -> Column:
    return n * rf * factor


def relative_opening(area: Column, idle: Column, low: float, high: float, divisor: Column, cap: int = 65535) -> Column:
    total = area + idle
    share = F.try_divide((total - low) / (high - low) * cap, divisor)
    return F.when(total < low, F.lit(0.0)).otherwise(F.least(share, F.lit(float(cap))))


def load_path(bits: Column) -> Column:
    """Which formula gives the filling, by configuration bits."""
    return F.when(bits.bitwiseAND(F.lit(1)) != 0, "pressure").when(bits.bitwiseAND(F.lit(2)) != 0, "throttle").when(bits.bitwiseAND(F.lit(4)) != 0, "airmass").otherwise("model")


def flag_bits(word: Column, names: list[str]) -> Column:
    return F.struct(*((F.getbit(word, F.lit(i)) == 1).alias(n) for i, n in enumerate(names)))


def lookahead_time(dn: Column, distance: Column, t: Column) -> Column:
    return F.try_divide(F.least(distance, t * dn), dn)


def neutral(value: Column, low: float, high: float) -> Column:
    """In the band in which a correction is held to be neutral."""
    return value.between(low, high)


def floor_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a - F.floor(F.try_divide(a, b)) * b)
