"""Scalar helpers over columns: truth of values, names, urls, text in 16-bit units."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, types as T
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def truthy(value: Column, kind: T.DataType) -> Column:
    """Truth of a value: false for null, false, 0, NaN and empty text; lists, bytes and structs are true, also empty ones."""
    if isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        test = (value != 0) & ~F.isnan(value)
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, T.StringType):
        test = value != ""
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def default_of(kind: T.DataType):
    """What an unset field reads as."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[default_of(f.dataType).alias(f.name) for f in kind])
    return F.lit(None).cast(kind)


def with_defaults(value: Column, kind: T.DataType) -> Column:
    """value with the default of its kind for null."""
    return F.coalesce(value, default_of(kind))


def utf16_length(text: Column) -> Column:
    """Length in 16-bit units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def snake_case(name: Column, most: int = 64) -> Column:
    words = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.substring(F.lower(F.regexp_replace(words, "^_+|_+$", "")), 1, most)


def pascal_case(name: Column) -> Column:
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def camel_case(name: Column) -> Column:
    pascal = pascal_case(name)
    return F.concat(F.lower(F.substring(pascal, 1, 1)), F.substr(pascal, F.lit(2)))


def masked_url(url: Column) -> Column:
    """A url without its user part and without the values of parameters that name secrets."""
    bare = F.regexp_replace(url, "://[^/@?#]*@", "://***@")
    return F.regexp_replace(bare, "(?i)([?&](?:[a-z_-]*(?:token|key|secret|password|auth)[a-z_-]*)=)[^&#]*", "$1***")


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | ((status >= 500) & (status != 501))


def backoff_ms(attempt: Column, base: int = 100, most: int = 10_000) -> Column:
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt)).cast("long")


def kebab_to_camel(name: Column) -> Column:
    parts = F.split(name, "-")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def identifier(name: Column) -> Column:
    """A name with `_` for what identifiers cannot hold, and before a digit at its start."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_$]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def sign_extended(value: Column, bits: int) -> Column:
    """The low bits of a long as a signed number."""
    return F.shiftright(F.shiftleft(value.cast("long"), 64 - bits), 64 - bits)


def unsigned(value: Column, bits: int) -> Column:
    """The low bits of a long as a number from 0; of 64 bits as a decimal."""
    value = value.cast("long")
    if bits < 64:
        return value.bitwiseAND(F.lit((1 << bits) - 1))
    whole = value.cast("decimal(20,0)")
    return F.when(value < 0, whole + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(whole)


def composed(high: Column, low: Column) -> Column:
    """The long of two 32-bit halves."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(unsigned(low, 32))


def bit_set(value: Column, bit: int, on: Column) -> Column:
    mask = F.shiftleft(F.lit(1).cast("long"), bit)
    return F.when(on, value.bitwiseOR(mask)).otherwise(value.bitwiseAND(F.bitwise_not(mask)))


def xor_default(stored: Column, default: int) -> Column:
    """A value that is stored as its difference in bits from the default."""
    return F.coalesce(stored.cast("long"), F.lit(0).cast("long")).bitwiseXOR(F.lit(default).cast("long"))


def double_of_bits(bits: Column) -> Column:
    """The double whose 64 bits a long has; powers of two are exact."""
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1))
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    tiny = fraction.cast("double") * F.lit(2.0**-1074)
    usual = (F.lit(1.0) + fraction.cast("double") * F.lit(2.0**-52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, tiny).when(exponent == 0x7FF, special).otherwise(usual)


def float_of_bits(bits: Column) -> Column:
    """The 32-bit float whose bits the low half of a long has."""
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1))
    sign = F.when(F.getbit(bits, F.lit(31)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    tiny = fraction.cast("double") * F.lit(2.0**-149)
    usual = (F.lit(1.0) + fraction.cast("double") * F.lit(2.0**-23)) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 0, tiny).when(exponent == 0xFF, special).otherwise(usual)).cast("float")


def bits_of_double(value: Column) -> Column:
    """The 64 bits of a double as a long; Arrow batches, as Spark has no such function."""
    @pandas_udf("long")
    def view(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(np.float64).view(np.int64)).where(x.notna() | np.isnan(x.astype(float)), None)

    return view(value)


def encoded(value: Column) -> Column:
    """A value percent-encoded as one segment of a path: blanks too are %20."""
    kept = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "+": "%20"}
    out = F.url_encode(value.cast("string"))
    for code, char in kept.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def filled(template: str, **params: Column) -> Column:
    """A path with `{name}` slots filled; a slot without a parameter, or with a null one, is an error."""
    out, at = [], 0
    for slot in re.finditer(r"\{([^}]+)\}", template):
        missing = F.raise_error(F.lit(f"missing path parameter {slot[1]!r} for template {template!r}")).cast("string")
        value = params.get(slot[1])
        out += [F.lit(template[at : slot.start()]), missing if value is None else F.when(value.isNull(), missing).otherwise(encoded(value))]
        at = slot.end()
    return F.concat(*out, F.lit(template[at:]))


def with_query(url: Column, kinds: dict[str, T.DataType], **params: Column) -> Column:
    """A url with query parameters appended: nulls are left out, lists repeat the key, times are ISO texts, structs and maps JSON."""
    pairs = []
    for name, value in params.items():
        kind = kinds.get(name, T.StringType())
        if isinstance(kind, T.ArrayType):
            text = F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: x.cast("string"))
            pairs.append(F.coalesce(_pairs(name, text), F.array().cast("array<string>")))
        else:
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                value = iso(value)
            elif isinstance(kind, (T.StructType, T.MapType)):
                value = F.to_json(value)
            pairs.append(F.when(value.isNotNull(), _pairs(name, F.array(value.cast("string")))).otherwise(F.array().cast("array<string>")))
    query = F.array_join(F.concat(*pairs), "&")
    bare, fragment = F.regexp_extract(url, "^[^#]*", 0), F.regexp_extract(url, "#.*$", 0)
    glue = F.when(query == "", "").when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    return F.concat(bare, glue, query, fragment)


def _pairs(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(f"{name}="), F.url_encode(x)))


def joined_url(base: Column, path: Column) -> Column:
    """A base and a path with one slash between them; an absolute path stands alone."""
    base, path = F.coalesce(base, F.lit("")), F.coalesce(path, F.lit(""))
    slashes = base.endswith("/").cast("int") + path.startswith("/").cast("int")
    both = F.when(slashes == 2, F.concat(base, F.substr(path, F.lit(2)))).when(slashes == 0, F.concat(base, F.lit("/"), path)).otherwise(F.concat(base, path))
    return F.when(base == "", path).when(path == "", base).when(path.rlike("(?i)^[a-z][a-z0-9+.-]*:"), path).otherwise(both)


def epoch_ms(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def of_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso(at: Column) -> Column:
    """A time as text with milliseconds and Z, in UTC."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def probably_utf8(data: Column, first: int = 64) -> Column:
    """Whether the first bytes may be text: valid UTF-8, but for a character cut off where they end."""
    head = F.substring(data, 1, first + 3)
    valid = lambda n: F.is_valid_utf8(F.substring(head, 1, n).cast("binary"))
    cut = [valid(first + i) for i in range(4)]
    return F.when(F.octet_length(data) <= first, valid(first)).otherwise(cut[0] | cut[1] | cut[2] | cut[3])


def of_base64(text: Column) -> Column:
    """Bytes of base64 text, standard or url-safe, with any white space."""
    return F.unbase64(F.translate(F.regexp_replace(text, r"\s+", ""), "-_", "+/"))


def of_hex(text: Column) -> Column:
    """Bytes of hex text with any `0x`, white space and `, ; :` between; null if it is empty, odd or no hex."""
    clean = F.regexp_replace(F.regexp_replace(text, "(?i)0x", ""), r"[\s,;:]+", "")
    return F.when((clean != "") & (F.length(clean) % 2 == 0) & clean.rlike("^[0-9A-Fa-f]+$"), F.unhex(clean))


def hex_preview(data: Column, most: int = 32) -> Column:
    """The first bytes in hex with blanks between, and how many more there are."""
    shown = F.trim(F.regexp_replace(F.lower(F.hex(F.substring(data, 1, most))), "(..)", "$1 "))
    more = F.octet_length(data) - most
    return F.when(more > 0, F.concat(shown, F.lit("  …(+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def jittered_ms(attempt: Column, base: int = 100, most: int = 10_000, linear: bool = False, jitter: Column | None = None) -> Column:
    """Milliseconds before a further attempt: doubling or linear, at most `most`, times a jitter from 0 to 1 if one is given."""
    wait = F.lit(base) * (attempt + 1).cast("double") if linear else F.lit(base) * F.pow(F.lit(2.0), attempt)
    wait = F.least(F.lit(most).cast("double"), wait)
    return (wait if jitter is None else wait * jitter).cast("long")


def canonical(json_text: Column) -> Column:
    """JSON text without blanks and with the keys of all objects in order, at any depth; null if it is no JSON."""
    @pandas_udf("string")
    def sort(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return sort(json_text)


def not_blank(text: Column) -> Column:
    """The text without blanks about it; one of blanks alone, or null, is an error."""
    bare = F.trim(text)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.raise_error(F.lit("the text is blank")).cast("string")).otherwise(bare)


def suffixed(names: Column) -> Column:
    """A list of names without repeats: the second of a name gets `_2`, and so on."""
    nth = lambda x, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x))
    return F.transform(names, lambda x, i: F.when(nth(x, i) > 1, F.concat(x, F.lit("_"), nth(x, i).cast("string"))).otherwise(x))


def any_text(value: Column, path: str = "$") -> Column:
    """The text in a variant, null if something else is there."""
    return F.try_variant_get(value, path, "string")


def any_data(value: Column, path: str = "$") -> Column:
    """The bytes of a base64 text in a variant, null if something else is there."""
    return F.try_to_binary(any_text(value, path), F.lit("base64"))


def any_struct(value: Column, kind: str, path: str = "$") -> Column:
    """A variant read as a kind of struct or list; fields that it lacks are null."""
    return F.try_variant_get(value, path, kind)
