"""Plate texts: normal form, templates, repairs, validity, layout (ST4 to ST12, DT5, TK6), all as Column expressions.

A text is tried against each template of its length. A character in a wrong place
may be read as the one that it is commonly taken for; each such change costs one.
The cheapest reading wins, then the vehicle's family, then the templates' order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import PlateText

# Fixed values of the plate format.
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SERIAL_LETTERS = "ABCDEFGHKLMNPSTUVXYZ"
#: Codes from 11 to 99 that no locality has.
UNUSED_LOCALITIES = ("13", "42", "44", "45", "46", "87", "91", "96")
TEMPLATES = (("car_common", "DDLDDDD"), ("car_common", "DDLDDDDD"), ("motorbike_common", "DDLADDDD"), ("motorbike_common", "DDLADDDDD"))
#: Letters that are read as digits, and digits that are read as letters (1 is not: it could be two).
LETTERS_FOR_DIGITS, DIGITS_FOR_LETTERS = ("ILOZSGB", "1102568"), ("02568", "OZSGB")

CHANGE = "struct<index:int,from_char:string,to_char:string,reason:string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def normalise(text: Column, c: PlateText = PlateText()) -> Column:
    """ST4: without outer white space and separators; a to z in capitals. Null is empty."""
    bare = F.translate(strip(F.coalesce(text, F.lit(""))), c.separators, "")
    return F.translate(bare, LETTERS.lower(), LETTERS)


def unknown_characters(normal: Column) -> Column:
    """ST5: (index, char) outside digits and capitals."""
    chars = F.transform(F.split(normal, ""), lambda ch, i: F.struct(i.alias("index"), ch.alias("char")))
    return F.filter(chars, lambda x: (x["char"] != "") & ~x["char"].rlike("^[0-9A-Z]$"))


def preferred_family(vehicle_class: Column) -> Column:
    """ST12."""
    return F.when(vehicle_class == "motorcycle", "motorbike_common").when(vehicle_class.isin("car", "bus", "truck"), "car_common")


def expected(ch: Column, kind: str) -> Column:
    """ST6: the character that stands for ``ch`` in a place for a digit (D), letter (L) or either (A); null if none can."""
    if kind == "A":
        return F.when(ch.rlike("^[0-9A-Z]$"), ch)
    own, (other, as_own) = ("^[0-9]$", LETTERS_FOR_DIGITS) if kind == "D" else ("^[A-Z]$", DIGITS_FOR_LETTERS)
    return F.when(ch.rlike(own), ch).when(ch.rlike(f"^[{other}]$"), F.translate(ch, other, as_own))


def invalid_reason(text: Column, family: str) -> Column:
    """ST8: the first rule that a text of the family's length breaks; null if none."""
    serial = 1 if family == "car_common" else 2
    rules = F.when(~text.rlike("^[0-9]{2}"), "invalid_locality_prefix")
    rules = rules.when((F.substring(text, 1, 2) < "11") | F.substring(text, 1, 2).isin(*UNUSED_LOCALITIES), "unknown_locality_code")
    rules = rules.when(~F.substring(text, 3, 1).rlike(f"^[{SERIAL_LETTERS}]$"), "invalid_serial")
    if serial == 2:
        rules = rules.when(~F.substring(text, 4, 1).rlike(f"^[{SERIAL_LETTERS}0-9]$"), "invalid_serial")
    return rules.when(~F.substr(text, F.lit(3 + serial)).rlike("^[0-9]+$"), "invalid_registration_number")


def formatted(text: Column, family: Column) -> Column:
    """ST11."""
    head = F.when(family == "car_common", 3).otherwise(4)
    n = F.length(text)
    return F.concat(F.substr(text, F.lit(1), head), F.lit("-"), F.substr(text, head + 1, n - head - 2), F.lit("."), F.substr(text, n - 1, F.lit(2)))


def _read(text: Column, before: Column, order: int) -> Column:
    """ST7: what template ``order`` makes of a text: (cost, family, text, changes, reason); null if it cannot be read so."""
    family, pattern = TEMPLATES[order]
    chars = [F.substring(text, i + 1, 1) for i in range(len(pattern))]
    fixed = [expected(ch, kind) for ch, kind in zip(chars, pattern)]
    reading = F.concat(*fixed)  # null if any place has no character
    change = lambda i: F.struct(F.lit(i).alias("index"), chars[i].alias("from_char"), fixed[i].alias("to_char"), F.lit("digit_expected" if pattern[i] == "D" else "letter_expected").alias("reason"))
    changes = F.concat(before, F.filter(F.array(*[F.when(fixed[i] != chars[i], change(i)) for i in range(len(pattern)) if pattern[i] != "A"]), lambda x: x.isNotNull()))
    made = F.struct(F.size(changes).alias("cost"), F.lit(order).alias("priority"), F.lit(family).alias("family"), reading.alias("text"), changes.alias("changes"), invalid_reason(reading, family).alias("reason"))
    return F.when((F.length(text) == len(pattern)) & reading.isNotNull(), made)


def readings(text: Column, before: Column | None = None) -> Column:
    """All templates' readings of a text, in order."""
    before = F.array().cast(f"array<{CHANGE}>") if before is None else before
    return F.filter(F.array(*[_read(text, before, k) for k in range(len(TEMPLATES))]), lambda x: x.isNotNull())


def _deletions(normal: Column, confidences: Column, c: PlateText) -> Column:
    """ST9: readings after one doubtful character is left out. The median is the upper one (AG23)."""
    median = F.element_at(F.array_sort(confidences), F.floor(F.size(confidences) / 2).cast("int") + 1)

    def without(p: Column, i: Column) -> Column:
        gone = F.struct(i.cast("int").alias("index"), F.substr(normal, i + 1, F.lit(1)).alias("from_char"), F.lit("").alias("to_char"), F.lit("low_confidence_extra_character").alias("reason"))
        rest = F.concat(F.substr(normal, F.lit(1), i), F.substr(normal, i + 2))
        doubtful = (p <= c.extra_max_confidence) & (p <= median * c.extra_ratio)
        return F.when(doubtful, readings(rest, F.array(gone)))

    tried = F.flatten(F.filter(F.transform(confidences, without), lambda x: x.isNotNull()))
    return F.when((F.size(confidences) == F.length(normal)) & (F.length(normal) >= 1), tried)


def postprocess(raw: Column, confidence: Column, family: Column | None = None, char_confidences: Column | None = None, c: PlateText = PlateText()) -> Column:
    """DT5: the result as a struct: raw_text, normalized_text, corrected_text, formatted_text, format_family,
    corrections, correction_count, status, fusion_confidence, unknown_characters, format_valid, format_reason.

    ``family`` is the preferred one (it only breaks ties of cost). A null text is
    an empty one; null character confidences leave the deletion repair out.
    """
    text = F.coalesce(raw, F.lit(""))
    family = F.lit(None).cast("string") if family is None else family
    none = F.array().cast(f"array<{CHANGE}>")

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def finish(normal: Column) -> Column:
        def judged(own: Column) -> Column:
            if char_confidences is None:
                every = own
            else:
                repaired = F.coalesce(_deletions(normal, char_confidences, c), F.slice(own, 1, 0))
                every = F.when(F.exists(own, lambda x: x["reason"].isNull()), own).otherwise(F.concat(own, repaired))
            return let(every, pick)

        def pick(every: Column) -> Column:
            rank = lambda x, i: F.struct(x["cost"], F.when(family.isNull() | (x["family"] == family), 0).otherwise(1), x["priority"], i, x.alias("it"))
            good = F.array_min(F.filter(F.transform(every, lambda x, i: F.when(x["reason"].isNull(), rank(x, i))), lambda x: x.isNotNull()))
            bad = F.filter(every, lambda x: x["reason"].isNotNull())
            return let(F.struct(good["it"].alias("best"), F.get(bad, F.lit(0))["reason"].alias("why")), lambda p: result(p["best"], p["why"]))

        def result(best: Column, why: Column) -> Column:
            empty, none_fits = F.length(normal) == 0, best.isNull()
            costly = best["cost"] > c.max_corrections
            status = F.when(empty, "no_text").when(none_fits, "unrecognized_format").when(costly, "low_format_confidence").when(best["cost"] > 0, "corrected").otherwise("ok")
            reason = F.when(empty, "empty_text").when(none_fits, F.coalesce(why, F.lit("invalid_length"))).when(costly, "too_many_position_corrections")
            ok = F.coalesce(~empty & ~none_fits & ~costly, F.lit(False))
            return F.struct(
                text.alias("raw_text"),
                normal.alias("normalized_text"),
                F.when(ok, best["text"]).otherwise(normal).alias("corrected_text"),
                F.when(ok, formatted(best["text"], best["family"])).alias("formatted_text"),
                F.when(ok, best["family"]).alias("format_family"),
                F.when(ok, best["changes"]).otherwise(none).alias("corrections"),
                F.when(ok, best["cost"]).otherwise(0).alias("correction_count"),
                status.alias("status"),
                confidence.alias("fusion_confidence"),
                unknown_characters(normal).alias("unknown_characters"),
                ok.alias("format_valid"),
                reason.alias("format_reason"),
            )

        return let(readings(normal), judged)

    return let(normalise(text, c), finish)


def license_text(plate: Column) -> Column:
    """PR21: the first text of a plate that is not blank."""
    names = ("formatted", "text", "normalized_text", "raw_text")
    return F.coalesce(*[F.when(F.length(strip(plate[n])) > 0, plate[n]) for n in names])


def image_label(plate: Column) -> Column:
    """PR22."""
    return F.coalesce(strip(license_text(plate)), F.lit("unreadable"))


def video_label(plate: Column) -> Column:
    """PR23: a valid layout, else the normal form, else none."""
    filled = lambda x: F.when(F.length(x) > 0, x)
    return F.coalesce(F.when(plate["format_valid"], filled(plate["formatted"])), filled(plate["normalized_text"]))


def debug_label(plate: Column, index: Column, class_name: Column, confidence: Column) -> Column:
    return F.concat(F.coalesce(video_label(plate), F.lit("unread")), F.format_string(" P%d %s %.2f", index, class_name, confidence))
