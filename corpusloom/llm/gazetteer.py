"""Known values that speak for or against a span being personal, as one table to join by value.

Rows are (kind, value, vote, least, most): a value of the kind votes ``vote`` where the
span has ``least`` to ``most`` digits, and against it otherwise.  The lists are fixed
values of public registers; pass further rows to ``table_of`` to extend them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Row = tuple[str, str, int, int, int]
#: Generic top-level domains in wide use; those of countries come from the platform's ISO 3166 list.
GENERIC_DOMAINS = (
    "aero agency ai app art biz blog cat cloud club co com coop design dev digital edu email eu example gov group health "
    "info int io jobs law life live media mil mobi museum name net network news ngo one online org page pro shop site "
    "social solutions space store studio tech tel today tools top travel tv uk website wiki work world xyz"
).split()
#: Mailboxes of no person.
ROLE_MAILBOXES = "abuse admin donotreply hostmaster info mailer-daemon no-reply noreply postmaster root support webmaster".split()
#: Assigned country calling codes, as ranges.
CALLING_CODES = (
    (1, 1), (7, 7), (20, 20), (27, 27), (30, 34), (36, 36), (39, 41), (43, 49), (51, 58), (60, 66), (81, 82), (84, 84), (86, 86),
    (90, 95), (98, 98), (211, 213), (216, 216), (218, 218), (220, 258), (260, 269), (290, 291), (297, 299), (350, 359), (370, 378),
    (380, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509), (590, 599), (670, 670), (672, 683), (685, 692), (850, 850),
    (852, 853), (855, 856), (880, 880), (886, 886), (960, 968), (970, 977), (992, 996), (998, 998),
)
#: First digits of card numbers as ranges, with their least and greatest length.
ISSUERS = ((4, 4, 13, 19), (51, 55, 16, 16), (2221, 2720, 16, 16), (34, 34, 15, 15), (37, 37, 15, 15), (36, 36, 14, 19), (38, 38, 14, 19), (6011, 6011, 16, 19), (65, 65, 16, 19), (3528, 3589, 16, 19))
#: Address blocks of no single host on the internet, by first one or two numbers.
SPECIAL_BLOCKS = ("0", "10", "127", "169.254", "192.168", *(f"172.{i}" for i in range(16, 32)), *(str(i) for i in range(224, 256)))
#: Frequent given and family names in four languages, and large cities.  Given names and cities make
#: candidates (their patterns list them), family names vote.
GIVEN_NAMES = (
    "Alexander Alice Andrea Anna Anne Antonio Barbara Benjamin Camille Carlos Carmen Catherine Charles Christine Claire Claudia Daniel David Elena "
    "Elizabeth Emma Francisco Friedrich Hannah Hans Heinrich Isabelle James Javier Jean Jennifer Johannes John Jorge Joseph Juan Julia Julien Karl "
    "Katharina Klaus Laura Linda Lucas Luis Manuel Margaret Maria Marie Mary Matthew Michael Michel Miguel Monika Nicolas Patricia Paul Pedro Peter "
    "Petra Philippe Pierre Rafael Richard Robert Sarah Sophie Stefan Susan Susanne Thomas Ursula William Wolfgang"
).split()
FAMILY_NAMES = (
    "Anderson Bauer Becker Bernard Brown Davis Diaz Dubois Dupont Durand Fernandez Fischer Garcia Gomez Gonzalez Hernandez Hoffmann Jackson Johnson Jones "
    "Koch Lambert Laurent Lefebvre Leroy Lopez Martin Martinez Meyer Miller Moore Moreau Moreno Mueller Petit Perez Ramirez Richter Rodriguez Roux Ruiz "
    "Sanchez Schmidt Schneider Schulz Simon Smith Taylor Thompson Torres Wagner Weber White Williams Wilson Wolf Young Zimmermann"
).split()
CITIES = (
    "Amsterdam Atlanta Barcelona Berlin Bilbao Bogota Bordeaux Boston Brussels Chicago Cologne Dallas Denver Dresden Dublin Frankfurt Geneva Hamburg "
    "Houston Leipzig Lille Lima Lisbon London Lyon Madrid Malaga Manchester Marseille Miami Montreal Munich Nantes Nice Paris Philadelphia "
    "Phoenix Quito Rome Santiago Seattle Sevilla Strasbourg Stuttgart Toronto Toulouse Valencia Vienna Warsaw Zurich"
).split()


def rows(spark: SparkSession) -> list[Row]:
    """The table's own rows, about 1,700."""
    countries = [c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()]
    any_length = (0, 1 << 30)
    out: list[Row] = [(kind, v, 1, *any_length) for kind in ("email", "spelled") for v in sorted({*GENERIC_DOMAINS, *countries})]
    out += [("email", f"{v}@", -1, *any_length) for v in ROLE_MAILBOXES]
    out += [("ip", v, -1, *any_length) for v in SPECIAL_BLOCKS]
    # with the code: eleven digits in North America, eight to fifteen elsewhere
    out += [("phone", str(c), 1, *((11, 11) if c == 1 else (8, 15))) for low, high in CALLING_CODES for c in range(low, high + 1)]
    out += [(kind, str(c), 1, least, most) for kind in ("card", "number") for low, high, least, most in ISSUERS for c in range(low, high + 1)]
    out += [("name", v.lower(), 1, *any_length) for v in FAMILY_NAMES]
    return out


def table_of(spark: SparkSession, kinds: Iterable[str], more: Iterable[Row] = ()) -> DataFrame:
    """The table with ``kind`` as its place among ``kinds``; later rows stand for earlier ones of the same kind and value.

    It goes into the plan as one literal of lines, so no Python worker takes part.
    """
    at = {k: i for i, k in enumerate(kinds)}
    held = {(at[k], v): (vote, least, most) for k, v, vote, least, most in [*rows(spark), *more]}
    lines = "\n".join("\t".join(map(str, (*key, *rest))) for key, rest in held.items())
    parts = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line")).select(F.split("line", "\t").alias("p"))
    return parts.select(*[F.col("p")[i].cast(t).alias(n) for i, (n, t) in enumerate((("kind", "int"), ("value", "string"), ("vote", "int"), ("least", "int"), ("most", "int")))])
