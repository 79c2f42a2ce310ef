"""Names by locale, put together from weighted syllables, so that there is no list of them and no end to them.

A table of weights is drawn from by the alias method (Vose 1991): one uniform number gives a slot and the choice
between the slot's own syllable and its alias, so a draw costs two array reads whatever the table's size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.draws import Cell, pick, pick_sql, uniform_sql

MIDDLES = {"": 3, "1": 5, "2": 2}  # how often a word has none, one or two middle syllables


@dataclass(frozen=True)
class Alias:
    """Values, and for each slot the share of its own value and the value that has the rest."""

    values: tuple[str, ...]
    shares: tuple[float, ...]
    others: tuple[str, ...]

    @staticmethod
    def of(weights: dict[str, float]) -> Alias:
        values, n, total = list(weights), len(weights), sum(weights.values())
        left = [w * n / total for w in weights.values()]
        small, large = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
        shares, others = [1.0] * n, list(values)
        while small and large:
            i, j = small.pop(), large[-1]
            shares[i], others[i] = left[i], values[j]
            left[j] -= 1 - left[i]
            if left[j] < 1:
                small.append(large.pop())
        return Alias(tuple(values), tuple(shares), tuple(others))

    def drawn(self, u: Column) -> Column:
        slot = pick(u, len(self.values))
        at = lambda x: F.element_at(F.array(*map(F.lit, x)), (slot + 1).cast("int"))
        return F.when(u * len(self.values) - slot < at(self.shares), at(self.values)).otherwise(at(self.others))

    def drawn_sql(self, u: str) -> str:
        slot = pick_sql(u, len(self.values))
        text = lambda x: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in x) + "]"
        shares = "[" + ", ".join(f"{s!r}::DOUBLE" for s in self.shares) + "]"
        return f"CASE WHEN {u} * {len(self.values)} - {slot} < ({shares})[{slot} + 1] THEN ({text(self.values)})[{slot} + 1] ELSE ({text(self.others)})[{slot} + 1] END"


#: Syllables and weights: what a word begins with, what may follow, what it ends with.
SYLLABLES: dict[str, dict[str, tuple[str, str, str]]] = {
    "es_ES": {
        "first": ("Ma9 Lu6 Jo7 An8 Car6 El5 Ro5 Pa5 Mi5 Al6 Fer3 Cris3 Jua3 Te3 Be4 Vi4 Gon2 San3 Ra4 Do3", "ri8 ci5 be5 na6 lo5 mi4 ra6 di4 vi3 ne5 to3 sa4 li6 ma4", "na7 ta5 do5 rio4 la6 cia4 no5 lia4 nia4 so3 ro4 sa3 va2 len2 bel3 el4"),
        "last": ("Gar8 Mar7 Lo6 Fer6 Gon5 Ro7 San6 Pe6 Mu4 Al5 Her4 Ca5 Be4 Vi3 Ra4 Cas4 Or3 Del3 Na3 Ser3", "ti5 nan4 za4 dri4 che3 ran4 mo4 ni4 bo3 la4 da3 re4 me3", "ez9 cía3 rez6 nez6 do3 na4 lez4 guez5 no4 ero3 osa2 edo2 illa3 era3"),
        "city": ("Val8 Mon6 Al7 Cas5 Vi6 San5 Ri4 Be4 Mo4 Pue3 Tor5 Al4 Ca6 Gra3 Le4", "de5 ta5 me4 li4 ra5 ce3 go3 lla4 na4 va3", "ra6 nar4 lba3 rejo4 nosa3 sar3 llas4 guna3 da5 ña3 dor3"),
    },
    "en_US": {
        "first": ("Ja8 Ma8 An7 Mi6 El6 Jo6 Ke4 Da5 Be4 Li5 Sa5 Ro5 Ha4 Ca4 Wil4 Ste3 Tho3 Gra3 Ev3 Na3", "li5 ra5 mi4 na5 ni4 ri4 ro3 bi3 de3 la4 se3 vi3", "n8 ne6 son4 na6 el5 y7 th4 ly4 rd3 lia3 ck3 us2 ce4 m3"),
        "last": ("Har7 Wil7 John6 Ma6 Ander5 Thom5 Ro6 Bak4 Car5 Ed4 Mil5 Col4 Par4 Ben4 Whit3 Ash3 Brad3 Wal4 Hen4", "ing4 er6 ar4 en5 el3 on4 le3 ber3 ma3", "son9 s6 ton6 er5 ley5 man5 ford4 well3 field3 wood4 ham3 by2 land3"),
        "city": ("Spring6 Green6 Fair5 Oak5 Lake6 Mill4 Cedar4 River5 Clay3 Brook4 Maple3 North4 West4 Ash3 Glen3", "en3 er4 s3 ing2 a2", "field6 ville6 ton7 wood5 dale4 burg4 port3 view3 ford4 ham3 side2"),
    },
}


def table(text: str) -> Alias:
    return Alias.of({part.rstrip("0123456789"): float(part[len(part.rstrip("0123456789")) :]) for part in dict.fromkeys(text.split())})


def tables(locale: str, kind: str) -> list[Alias]:
    """How many middle syllables, then the beginnings, middles and ends."""
    return [Alias.of(MIDDLES), *map(table, SYLLABLES[locale][kind])]


def word(cell: Cell, locale: str, kind: str) -> Column:
    """A word of a kind: first, last or city."""
    count, start, middle, end = tables(locale, kind)
    n = count.drawn(cell.u(f"{kind}.n"))
    inner = F.when(n == "", "").otherwise(middle.drawn(cell.u(f"{kind}.m1")))
    inner = F.concat(inner, F.when(n == "2", middle.drawn(cell.u(f"{kind}.m2"))).otherwise(""))
    return F.concat(start.drawn(cell.u(f"{kind}.s")), inner, end.drawn(cell.u(f"{kind}.e")))


def word_sql(seed: int, table_: str, column: str, locale: str, kind: str, idx: str) -> str:
    count, start, middle, end = tables(locale, kind)
    u = lambda part: uniform_sql(seed, table_, f"{column}/{kind}.{part}", idx)
    n = count.drawn_sql(u("n"))
    inner = f"CASE WHEN {n} = '' THEN '' ELSE {middle.drawn_sql(u('m1'))} END || CASE WHEN {n} = '2' THEN {middle.drawn_sql(u('m2'))} ELSE '' END"
    return f"({start.drawn_sql(u('s'))}) || {inner} || ({end.drawn_sql(u('e'))})"
