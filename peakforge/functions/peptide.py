"""Peptide strings as column expressions: tokens, ids, masses and m/z."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions import constants as K
from peakforge.functions.binding import let


def vocabulary(spark: SparkSession, residues: dict[str, float] = K.RESIDUES) -> DataFrame:
    """(id, token, mass, n_term): specials first, then residues in their order."""
    rows = [(K.PAD, "PAD", 0.0), (K.SOS, "SOS", 0.0)] + [(i, t, float(m)) for i, (t, m) in enumerate(residues.items(), 2)]
    return spark.createDataFrame(rows, "id int, token string, mass double").withColumn("n_term", F.col("token").rlike("^[+-]"))


def token_predicates(vocab: DataFrame) -> DataFrame:
    """vocab with what decoding asks of a token: special (PAD, SOS), n_term (a modification alone, which begins with a sign), negative (it takes mass away)."""
    return vocab.withColumns({"special": F.col("id") <= K.SOS, "n_term": F.col("token").rlike("^[+-]"), "negative": F.col("mass") < 0})


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def id_map(residues: dict[str, float] = K.RESIDUES) -> Column:
    return _map((t, i) for i, t in enumerate(residues, 2))


def mass_map(residues: dict[str, float] = K.RESIDUES) -> Column:
    return _map(residues.items())


def split_residues(peptide: Column) -> Column:
    """Tokens of a peptide: a new one before each capital; an empty peptide has one empty token."""
    return F.split(peptide, "(?<=.)(?=[A-Z])")


def merge_isomers(peptide: Column) -> Column:
    return F.replace(peptide, F.lit("I"), F.lit("L"))


def tokenize(peptide: Column, max_len: int = 100, reverse: bool = False, strict: bool = False) -> Column:
    """SOS, ids, SOS. Reversal comes before truncation. An unknown residue gives null, or an error if strict."""
    tokens = split_residues(merge_isomers(peptide))
    tokens = F.slice(F.reverse(tokens) if reverse else tokens, 1, max_len)
    error = F.raise_error(F.lit("unknown residue")).cast("array<int>") if strict else F.lit(None)
    whole = lambda ids: F.concat(F.array(F.lit(K.SOS)), ids, F.array(F.lit(K.SOS)))
    return let(F.transform(tokens, lambda t: id_map()[t]), lambda ids: F.when(F.exists(ids, lambda i: i.isNull()), error).otherwise(whole(ids)))


def valid_tokens(ids: Column) -> Column:
    """What lies between the first two SOS; after the only one to the end; everything without one."""

    def cut(a: Column) -> Column:
        first = F.array_position(a, K.SOS).cast("int")
        return F.when(first == 0, a).otherwise(let(F.slice(a, first + 1, F.size(a)), before))

    def before(rest: Column) -> Column:
        second = F.array_position(rest, K.SOS).cast("int")
        return F.when(second == 0, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(second - 1, F.lit(0))))

    return let(ids, cut)


def detokenize(ids: Column, reverse: bool = False) -> Column:
    names = _map(chain([(K.PAD, "PAD"), (K.SOS, "SOS")], ((i, t) for i, t in enumerate(K.RESIDUES, 2))))
    tokens = F.transform(valid_tokens(ids), lambda i: names[i])
    return F.array_join(F.reverse(tokens) if reverse else tokens, "")


def masses(tokens: Column) -> Column:
    """Mass of each token; 0 for an unknown one."""
    return F.transform(tokens, lambda t: F.coalesce(mass_map()[t], F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def peptide_mass(tokens: Column) -> Column:
    return total(masses(tokens)) + F.lit(K.H2O)


def mass_to_mz(mass: Column, charge: Column) -> Column:
    """m/z, or the mass itself without a charge."""
    return F.when(charge > 0, mass / charge + F.lit(K.PROTON)).otherwise(mass)


def mz_to_mass(mz: Column, charge: Column) -> Column:
    return (mz - F.lit(K.PROTON)) * charge


def prefix_masses(tokens: Column) -> Column:
    return let(masses(tokens), lambda m: F.transform(m, lambda _, i: total(F.slice(m, F.lit(1), i + 1))))


def neutral_losses(fragment: Column) -> Column:
    return F.array(fragment, fragment - F.lit(K.H2O), fragment - F.lit(K.NH3))


def isotope_ppm(predicted: Column, target: Column, charge: Column, isotopes: int = 1) -> Column:
    """Smallest error in ppm over the isotope shifts 0 to isotopes."""
    return F.array_min(F.array(*[F.abs(predicted - (target - F.lit(k * K.ISOTOPE) / charge)) / target * 1e6 for k in range(isotopes + 1)]))


def rename_residues(peptide: Column, names: dict[str, str]) -> Column:
    return F.array_join(F.transform(split_residues(peptide), lambda t: F.coalesce(_map(names.items())[t], t)), "")
