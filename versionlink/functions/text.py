"""Text and path transforms, as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns of the input formats.
SKIPPED_LINE = r"^\s*#|^\s*[\{\}]\z"
LINE_COMMENT = r"//[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
JUMP_TARGET = r"<(.+)\+0x([0-9a-f]+)>"
TRAILING_SPACE = r"(?U)\s+\z"


def normal_path(path: Column) -> Column:
    """Fold empty, ``.`` and ``..`` components; exactly two leading slashes stay."""
    slashes = F.regexp_extract(path, r"^/*", 0)
    root = F.when(F.length(slashes) == 2, F.lit("//")).when(F.length(slashes) > 0, F.lit("/")).otherwise("")
    absolute = F.length(slashes) > 0

    def fold(stack, part):
        top = F.try_element_at(stack, F.lit(-1))
        up = part == ".."
        pops = up & top.isNotNull() & (top != "..")
        return (
            F.when(part.isin("", "."), stack)
            .when(pops, F.slice(stack, F.lit(1), F.size(stack) - 1))
            .when(up & absolute, stack)
            .otherwise(F.array_append(stack, part))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    whole = F.concat(root, F.array_join(kept, "/"))
    return F.when(whole == "", F.lit(".")).otherwise(whole)


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*/", "")


def levels(path: Column) -> Column:
    """Path components from the file name up, to be ``posexplode``d."""
    return F.reverse(F.split(path, "/"))


def without_line_comment(code: Column) -> Column:
    return F.regexp_replace(code, LINE_COMMENT, "")


def is_linkable(code: Column) -> Column:
    """False for preprocessor lines and lone braces."""
    return ~code.rlike(SKIPPED_LINE)


def plain_words(code: Column) -> Column:
    """The words of a line with one space between them."""
    return F.regexp_replace(F.trim(F.regexp_replace(code, r"\s+", " ")), r"\A\s+|\s+\z", "")


def words(code: Column) -> Column:
    return F.split(plain_words(code), " ")


def code_lines(text: Column) -> Column:
    """Lines of one file as ``array<struct<line, code>>``, block comments removed.

    Every line carries its number as a marker through the comment removal, so
    code before a comment that spans lines is credited to the line where the
    comment ends. Blank lines are dropped.
    """
    raw = F.split(text, r"\r\n|\r|\n")
    marked = F.transform(
        raw,
        lambda code, i: F.concat(
            F.regexp_replace(code, TRAILING_SPACE, ""), F.lit(" //"), (i + 1).cast("string")
        ),
    )
    clean = F.split(F.regexp_replace(F.array_join(marked, "\n"), BLOCK_COMMENT, ""), "\n")
    kept = F.filter(clean, lambda v: ~v.rlike(r"\A[ \t]+//\d+\z"))
    pattern = r"(?s)\A(.*) //(\d+)\z"
    return F.transform(
        kept,
        lambda v: F.struct(
            F.regexp_extract(v, pattern, 2).cast("bigint").alias("line"),
            F.regexp_extract(v, pattern, 1).alias("code"),
        ),
    )


def position_file(text: Column) -> Column:
    """Clean the ``; path:line`` text of a listing's position line."""
    text = F.regexp_replace(text, r"\A;\s", "")
    text = F.regexp_replace(text, r"/(\./)+", "/")
    text = F.regexp_replace(text, r"\A\./", "")
    # only the first folder of this name is dropped
    text = F.regexp_replace(text, r"(?s)\A(.*?)obj/", "$1")
    return F.regexp_replace(text, r"\A.*/\.\./", "")


def opcode(instruction: Column) -> Column:
    return F.split(instruction, "\t", 2).getItem(0)


def operand(instruction: Column) -> Column:
    """Text after the first tab; an absolute address before ``<`` is dropped."""
    rest = F.coalesce(F.get(F.split(instruction, "\t", 2), F.lit(1)), F.lit(""))
    return F.regexp_replace(rest, r"(?s)\A(.*?)0x[0-9a-f]+\s<", "$1<")


def jump_name(code: Column, argument: Column) -> Column:
    hit = F.regexp_extract(argument, JUMP_TARGET, 1)
    return F.when(code.startswith("j") & (hit != ""), hit)


def jump_offset(code: Column, argument: Column) -> Column:
    hit = F.regexp_extract(argument, JUMP_TARGET, 2)
    return F.when(code.startswith("j") & (hit != ""), F.conv(hit, 16, 10).cast("bigint"))


def signed(text: Column) -> Column:
    """Unsigned 64-bit text as signed bigint (2^64-1 becomes -1)."""
    return F.conv(text, 10, -10).cast("bigint")


def digest(code: Column) -> Column:
    """32 bytes that stand for a text where steps only ask whether texts are equal (SHA-256)."""
    return F.unhex(F.sha2(code, 256))
