"""Sequence functions as column expressions.

A k-mer of up to 31 bases is a LONG of 2 bits a base, first base highest: A=0 C=1 G=2 T=3, so the
order of the numbers is the order of the strings. All arithmetic stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 31
# The nucleotide codes and their complements.
IUPAC = "ACGTNRYSWKMBDHV"
IUPAC_COMPLEMENT = "TGCANYRSWMKVHDB"
#: Marks the departing copy of a palindrome (even k only).
DEPART = 1 << 62


def check_k(k: int) -> int:
    if not 3 <= k <= MAX_K:
        raise ValueError(f"k must be from 3 to {MAX_K}")
    return k


def lit(x: int) -> Column:
    return F.lit(x).cast("long")


def mask(k: int) -> int:
    return (1 << 2 * k) - 1


def is_dna(s: Column) -> Column:
    """True for strings of A, C, G and T in either case; true for the empty string."""
    return F.translate(F.upper(s), "ACGT", "") == ""


def reverse_complement(s: Column) -> Column:
    """Of an upper-case string, IUPAC codes included."""
    return F.reverse(F.translate(s, IUPAC, IUPAC_COMPLEMENT))


def canonical(s: Column) -> Column:
    return F.least(s, F.reverse(F.translate(s, "ACGT", "TGCA")))


def clean_sequence(s: Column) -> Column:
    """Upper case, with N for every character that is no base."""
    return F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^ACGT]", "N")


def text_to_dna(text: Column) -> Column:
    """A DNA reading of text: blanks dropped, the letters a to z dealt to A, C, G and T in turn, all else N."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    dealt = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("")), letters, ("ACGT" * 7)[: len(letters)])
    return F.regexp_replace(dealt, "[^ACGT]", "N")


def pack(s: Column) -> Column:
    """A string over ACGT as a LONG."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long")


def unpack(x: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(x.bitwiseAND(lit(mask(k))).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def twin(x: Column, k: int) -> Column:
    """Reverse complement of a packed k-mer: complement, then reverse the order of the 2-bit groups."""
    v = F.bitwise_not(x)
    for bits, m in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        v = F.shiftrightunsigned(v, bits).bitwiseAND(lit(m)).bitwiseOR(F.shiftleft(v.bitwiseAND(lit(m)), bits))
    return F.shiftrightunsigned(v, 64 - 2 * k)


def rep(x: Column, k: int) -> Column:
    """Canonical form: the smaller of a packed k-mer and its twin."""
    return F.least(x, twin(x, k))


def forward(x: Column, base: Column | int, k: int) -> Column:
    """Drop the first base, append one."""
    b = lit(base) if isinstance(base, int) else base
    return F.shiftleft(x, 2).bitwiseAND(lit(mask(k))).bitwiseOR(b)


def backward(x: Column, base: Column | int, k: int) -> Column:
    """Drop the last base, put one in front."""
    b = lit(base) if isinstance(base, int) else base
    return F.shiftrightunsigned(x, 2).bitwiseOR(F.shiftleft(b, 2 * (k - 1)))


def prefix(x: Column, k: int) -> Column:
    """The first k-1 bases."""
    return F.shiftrightunsigned(x, 2).bitwiseAND(lit(mask(k - 1)))


def suffix(x: Column, k: int) -> Column:
    """The last k-1 bases."""
    return x.bitwiseAND(lit(mask(k - 1)))


def base_at(x: Column, i: int, k: int) -> Column:
    """Code of the base at a place from 0."""
    return F.shiftrightunsigned(x, 2 * (k - 1 - i)).bitwiseAND(lit(3))


def set_base(x: Column, i: int, code: int, k: int) -> Column:
    at = 2 * (k - 1 - i)
    return x.bitwiseAND(lit(mask(k) ^ (3 << at))).bitwiseOR(lit(code << at))


def kmer_hash(x: Column) -> Column:
    return F.xxhash64(x)


def default_g(k: int) -> int:
    """Minimizer length chosen for k where none is given. Fixed values."""
    for least, less in ((27, 8), (25, 7), (23, 6), (21, 5), (19, 4)):
        if k >= least:
            return k - less
    return k - 2


def minimizer(x: Column, k: int, g: int | None = None, ends: bool = True) -> Column:
    """The canonical g-mer of least hash in a packed k-mer; without ``ends`` the first and last do not count."""
    g = default_g(k) if g is None else g
    if not 1 <= g <= k - 2:
        raise ValueError("g must be from 1 to k - 2")
    first, last = (0, k - g) if ends else (1, k - g - 1)

    def at(y: Column, i: Column) -> Column:
        return F.call_function("shiftrightunsigned", y, 2 * (k - g - i)).bitwiseAND(lit(mask(g)))

    # The twin of the g-mer at i is the g-mer at k - g - i of the k-mer's twin, which is bound once.
    def least_of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.least(at(x, i), at(t, k - g - i)))
        return F.array_min(F.transform(grams, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("g"))))["g"]

    return F.element_at(F.transform(F.array(twin(x, k)), least_of), 1)


def substitutions(x: Column, k: int) -> Column:
    """The 3k packed k-mers with one base changed."""
    masks = F.array(*[lit(d << 2 * i) for i in range(k) for d in (1, 2, 3)])
    return F.transform(masks, lambda m: x.bitwiseXOR(m))


def insertions(x: Column, k: int) -> Column:
    """The first k-1 bases with one base put in at any place."""
    y = F.shiftrightunsigned(x, 2)
    out = []
    for o in range(k):
        low = 2 * (k - 1 - o)
        kept = F.shiftleft(F.shiftrightunsigned(y, low), low + 2).bitwiseOR(y.bitwiseAND(lit((1 << low) - 1)))
        out += [kept.bitwiseOR(lit(b << low)) for b in range(4)]
    return F.array(*out)


def deletions(x: Column, following: Column, k: int) -> Column:
    """The k-mer and the base after it, with one base taken out."""
    out = []
    for o in range(k):
        low = 2 * (k - 1 - o)
        kept = F.shiftleft(F.shiftrightunsigned(x, low + 2), low).bitwiseOR(x.bitwiseAND(lit((1 << low) - 1)))
        out.append(F.shiftleft(kept, 2).bitwiseOR(following))
    return F.array(*out, x)
