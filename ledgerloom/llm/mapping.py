"""Mapping freely typed values to the entries of a reference list.

Each token of a value is repaired: joined to the words of the reference list by edit distance or as an abbreviation.  The
repaired tokens are then compared with complete entries by soft TF-IDF, which weighs rare words more and repairs less the
further they went.  Values whose best entry stays below the threshold mean none.

The reference list is a dimension that travels to the tasks, in blocks of bounded size; values are mapped where they lie, without a
shuffle, and a repeated value costs a dictionary look-up.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require
from ledgerloom.llm.edits import NearWords, abbreviates

THRESHOLD = 0.74
#: Entries that are sent to the tasks at once; a longer list is mapped block by block, and the best entry of all blocks wins.
MAX_ENTRIES = 20_000
UNMATCHED = "unmatched"

# What the canonical measures are called in other words and other languages (en, de, fr, es).
OTHER_WORDINGS = {
    "going_in_yield": ("yield at acquisition", "Anfangsrendite", "rendement initial", "rentabilidad inicial"),
    "exit_yield": ("yield upon disposal", "Exit-Rendite", "rendement de sortie", "rentabilidad de salida"),
    "purchase_consideration": ("price paid at acquisition", "Kaufpreis", "prix d'achat", "precio de compra"),
    "appraised_value": ("value per appraiser", "Gutachterwert", "valeur d'expertise", "valor de tasación"),
    "asset_level_income": ("net income from property operations", "Nettobetriebsergebnis", "revenu net d'exploitation", "ingreso operativo neto"),
    "gross_rental_revenue": ("rents billed, gross", "Bruttomieteinnahmen", "revenus locatifs bruts", "ingresos brutos por alquiler"),
    "recoverable_expenses": ("costs recovered from tenants", "umlagefähige Kosten", "charges récupérables", "gastos recuperables"),
    "property_tax_bill": ("tax levied on the property", "Grundsteuer", "taxe foncière", "impuesto sobre bienes inmuebles"),
    "insurance_premium": ("premium for insurance", "Versicherungsprämie", "prime d'assurance", "prima de seguro"),
    "capital_works_budget": ("budget for capital works", "Investitionsbudget", "budget de travaux", "presupuesto de obras"),
    "loan_principal": ("principal still outstanding", "Restschuld", "capital restant dû", "principal pendiente del préstamo"),
    "annual_debt_service": ("debt service p.a.", "Kapitaldienst pro Jahr", "service annuel de la dette", "servicio anual de la deuda"),
    "security_deposit": ("deposit held as security", "Mietkaution", "dépôt de garantie", "fianza"),
    "tenant_improvement_fund": ("landlord fit-out money", "allowance for tenant improvements", "Ausbaukostenzuschuss", "participation aux travaux du locataire"),
    "leasing_commission": ("commission for leasing", "Maklerprovision Vermietung", "commission de location", "comisión de arrendamiento"),
    "rentable_floor_area": ("floor area for rent", "Mietfläche", "surface locative", "superficie alquilable"),
    "gross_floor_area": ("floor area, gross", "Bruttogrundfläche", "surface brute", "superficie bruta"),
    "site_area": ("area of the plot", "Grundstücksfläche", "superficie du terrain", "superficie de la parcela"),
    "vacant_floor_area": ("floor area standing vacant", "Leerstandsfläche", "surface vacante", "superficie vacante"),
    "storage_area": ("space for storage", "Lagerfläche", "surface de stockage", "superficie de almacén"),
    "value_per_area": ("price for each square foot", "Wert je Fläche", "valeur par surface", "valor por superficie"),
    "replacement_cost_per_area": ("cost to rebuild, per area", "Wiederherstellungskosten je Fläche", "coût de reconstruction par surface", "coste de reposición por superficie"),
    "contract_rent_rate": ("rent rate under contract", "Vertragsmiete", "loyer contractuel", "renta contractual"),
    "market_rent_rate": ("rent rate in the market", "Marktmiete", "loyer de marché", "renta de mercado"),
    "service_charge_rate": ("rate of service charge", "Nebenkostensatz", "charges locatives", "gastos comunes"),
    "weighted_lease_life": ("average lease life, weighted", "gewichtete Restlaufzeit", "durée moyenne pondérée des baux", "plazo medio ponderado de los contratos"),
    "initial_lease_duration": ("duration of lease, initial", "Mietvertragslaufzeit", "durée initiale du bail", "duración inicial del contrato"),
    "rent_free_span": ("span without rent", "mietfreie Zeit", "franchise de loyer", "carencia de renta"),
    "loan_tenor": ("tenor of the loan", "Kreditlaufzeit", "durée du prêt", "plazo del préstamo"),
    "physical_occupancy": ("share physically occupied", "Vermietungsstand", "taux d'occupation physique", "ocupación física"),
    "economic_occupancy": ("share economically occupied", "wirtschaftliche Vermietungsquote", "taux d'occupation économique", "ocupación económica"),
    "loan_to_value": ("loan / value", "Beleihungsauslauf", "ratio prêt valeur", "relación préstamo valor"),
    "management_fee_share": ("share taken as management fee", "Verwaltungsgebühr in Prozent", "honoraires de gestion", "honorarios de gestión"),
    "bad_debt_share": ("share of bad debts", "Forderungsausfallquote", "taux d'impayés", "tasa de morosidad"),
    "rent_indexation": ("yearly indexation of rent", "Mietindexierung", "indexation du loyer", "indexación de la renta"),
    "energy_consumption": ("consumption of energy", "Energieverbrauch", "consommation d'énergie", "consumo energético"),
    "parking_stalls": ("stalls for parking", "Stellplätze", "places de stationnement", "plazas de aparcamiento"),
    "dwelling_units": ("units for dwelling", "Wohneinheiten", "nombre de logements", "viviendas"),
    "daily_footfall": ("footfall each day", "Besucherfrequenz täglich", "fréquentation quotidienne", "afluencia diaria"),
}

# Abbreviations that leave no letters of the word in order, or that stand for several words.
SHORTHAND = {"o/s": "outstanding", "p.a.": "annual", "w/o": "without", "no.": "number"}
# Words that carry no meaning of their own, of the languages above.
LINKING = frozenset("a an and as at by each for from in of on per the to under upon with de del der des die du el en je la las le les los par por pour pro sur y et und d l".split())
# Remarks people append to a label.
_REMARK = re.compile(r"\((?:est\.?|unaudited|per sheet|audited|as stated|actual|draft|prelim\.?|rounded)\)|\[\d+\]|[,;]\s*see notes?\b.*$|\s[-–—]\s*(?:as stated|current|restated|draft|est\.?)\s*$|[*~†:#]+\s*$", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^\w&%$]+|_+")


def allowed_edits(length: int) -> int:
    """How many edits a word of this length can have and still be taken for another."""
    return 0 if length <= 2 else 1 if length <= 9 else 2


def plain(text: str) -> str:
    """Without remarks, accents and capitals."""
    t = unicodedata.normalize("NFKD", text.strip().replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.combining(c))
    while (shorter := _REMARK.sub(" ", t).strip()) != t and shorter:
        t = shorter
    t = t if t.isupper() else _CAMEL.sub(" ", t)
    return t.lower()


def tokens_of(text: str) -> list[str]:
    t = plain(text)
    for short, word in SHORTHAND.items():
        t = re.sub(rf"(?<!\w){re.escape(short)}(?!\w)", f" {word} ", t)
    return [w for w in _SPLIT.split(t) if w]


def _phrases(wordings: dict[str, list[str]]) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    return {(k, tuple(sorted(words))): words for k, ws in wordings.items() for w in ws if w and (words := tokens_of(w))}


def frequencies(wordings: dict[str, list[str]]) -> tuple[Counter, int]:
    """In how many wordings each word stands, and how many wordings there are."""
    phrases = _phrases(wordings)
    return Counter(w for words in phrases.values() for w in set(words)), len(phrases)


class Reference:
    """A reference list, ready to rank its entries for a value."""

    def __init__(self, wordings: dict[str, list[str]], frequency: Counter | None = None, n: int | None = None) -> None:
        """``frequency`` and ``n``: in how many of how many wordings each word stands, where this is a block of a longer list."""
        self.exact = {w.strip().lower(): k for k, ws in sorted(wordings.items()) for w in ws if w and w.strip()}
        self.phrases = [(k, words) for (k, _), words in sorted(_phrases(wordings).items())]
        frequency = frequency or frequencies(wordings)[0]
        n = n or len(self.phrases)
        own = {w for _, words in self.phrases for w in words}
        self.idf = {w: math.log(1 + n / f) * (0.15 if w in LINKING else 1.0) for w, f in frequency.items() if w in own}
        self.rarest = math.log(1 + n)
        self.mass: dict[tuple[str, ...], float] = {}
        self.with_word: dict[str, list[int]] = defaultdict(list)
        self.norm = []
        for i, (_, words) in enumerate(self.phrases):
            for w in set(words):
                self.with_word[w].append(i)
            self.norm.append(math.sqrt(sum(self.idf[w] ** 2 for w in words)))
        # Words people run together or break elsewhere: neighbours of an entry, and whole entries.
        self.compounds: dict[str, list[str]] = {}
        for _, words in self.phrases:
            for span in {*range(2, 3), len(words)}:
                for i in range(len(words) - span + 1):
                    if span > 1:
                        self.compounds.setdefault("".join(words[i : i + span]), words[i : i + span])
        self.near = NearWords([*self.idf, *self.compounds], allowed_edits)
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in self.idf:
            self.by_letter[w[0]].append(w)
        self.repair = lru_cache(maxsize=100_000)(self._repair)
        self.best = lru_cache(maxsize=200_000)(self._best)
        self.map = lru_cache(maxsize=200_000)(self._map)

    def _repair(self, token: str) -> tuple[tuple[tuple[str, ...], float], ...]:
        """The reference words a token can stand for, each with how sure that is."""
        if token in self.idf:
            self.mass.setdefault((token,), self.idf[token] ** 2)
            return (((token,), 1.0),)
        found: dict[tuple[str, ...], float] = {}
        for w, d in self.near.near(token).items():
            words = tuple(self.compounds[w]) if w in self.compounds else (w,)
            sure = 1.0 - d / max(4, len(w))
            found[words] = max(found.get(words, 0.0), sure if d else 0.99 if w in self.compounds else 1.0)
            if w in self.idf and w in self.compounds:
                found[(w,)] = max(found.get((w,), 0.0), sure)
        for w in self.by_letter.get(token[0], ()):
            if abbreviates(token, w) and w not in LINKING:
                found[(w,)] = max(found.get((w,), 0.0), 0.8 + 0.15 * len(token) / len(w))
        for words in found:
            self.mass.setdefault(words, sum(self.idf[w] ** 2 for w in words))
        return tuple(found.items())

    def _score(self, tokens: list[str]) -> tuple[float, str | None]:
        """The best entry for a way of splitting the value into tokens: soft TF-IDF over the repaired tokens."""
        reach: dict[int, dict[int, list[tuple[float, tuple[str, ...]]]]] = defaultdict(lambda: defaultdict(list))
        weight = []
        for at, token in enumerate(tokens):
            options = self.repair(token)
            known = max((sure for _, sure in options), default=0.0)
            weight.append(min((self.mass[words] for words, sure in options if sure >= known - 1e-9), default=(self.rarest * (0.15 if token in LINKING else 0.5 if token.isdigit() else 1.0)) ** 2))
            for words, sure in options:
                for i in self.with_word[words[0]]:
                    reach[i][at].append((sure, words))
        # What each entry could reach at best; only the most promising are scored in full, in that order, until none can win.
        hopes = sorted(((sum(max(sure * self.mass[words] for sure, words in got) for got in by.values()) / self.norm[i], i) for i, by in reach.items()), reverse=True)
        size = sum(weight)
        best: tuple[float, str | None] = (0.0, None)
        for hope, i in hopes:
            if best[1] is not None and hope / math.sqrt(size * 0.25) < best[0]:
                break
            key, words = self.phrases[i]
            left, total, length = list(words), 0.0, size
            matches = sorted(((sure * self.mass[w], sure, at, w) for at, got in reach[i].items() for sure, w in got), key=lambda m: (-m[0], m[2], m[3]))
            used = set()
            for _, sure, at, stands_for in matches:
                if at in used or not all(w in left for w in stands_for):
                    continue
                used.add(at)
                for w in stands_for:
                    if w in left:
                        left.remove(w)
                total += sure * self.mass[stands_for]
                length += self.mass[stands_for] - weight[at]
            best = max(best, (round(total / (math.sqrt(max(length, 1e-9)) * self.norm[i]), 6), key), key=lambda b: (b[0], b[1] or ""))
        return best

    def _best(self, tokens: tuple[str, ...]) -> tuple[float, str | None]:
        """The best entry for the tokens as they are, or else with two of them, or all, run together."""
        if not tokens:
            return 0.0, None
        best = self._score(list(tokens))
        if best[0] >= THRESHOLD or len(tokens) == 1:
            return best
        sure = [max((s for _, s in self.repair(t)), default=0.0) for t in tokens]
        ways = [[*tokens[:i], tokens[i] + tokens[i + 1], *tokens[i + 2 :]] for i in range(len(tokens) - 1) if min(sure[i], sure[i + 1]) < 1]
        ways += [["".join(tokens)]] if len(tokens) > 2 else []
        ways = [w for w in ways if any(len(words) > 1 or t not in tokens for t in w for words, _ in self.repair(t))]
        return max([best, *(self._score(w) for w in ways)], key=lambda b: (b[0], b[1] or ""))

    def _map(self, value: str, threshold: float) -> tuple[str, float]:
        """(entry, score), or (UNMATCHED, score of the best entry)."""
        key = value.strip().lower()
        if key in self.exact:
            return self.exact[key], 1.0
        score, entry = self.best(tuple(tokens_of(value)))
        return (entry, score) if entry and score >= threshold else (UNMATCHED, score)


def measure_wordings(measures: DataFrame, others: dict[str, tuple[str, ...]] = OTHER_WORDINGS) -> dict[str, list[str]]:
    """Slug, label, aliases and other wordings of each measure."""
    wordings: dict[str, list[str]] = {}
    for r in measures.where("slug IS NOT NULL").select("slug", "label", "aliases").toLocalIterator():
        wordings.setdefault(r.slug, []).extend([r.slug, r.label, *(r.aliases or []), *others.get(r.slug, ())])
    return {k: [w for w in ws if w] for k, ws in wordings.items()}


_MATCH = T.StructType([T.StructField("entry", T.StringType()), T.StructField("score", T.DoubleType())])


def _mapper(wordings: dict[str, list[str]], threshold: float, frequency: Counter | None, n: int | None):
    built: list[Reference] = []  # once per worker

    @F.arrow_udf(_MATCH)
    def match(values: pa.Array) -> pa.Array:
        if not built:
            built.append(Reference(wordings, frequency, n))
        got = [built[0].map(v, threshold) if v and v.strip() else (None, None) for v in values.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["entry", "score"])

    return match


def map_to_reference(values: DataFrame, column: str, wordings: dict[str, list[str]], threshold: float = THRESHOLD, block: int = MAX_ENTRIES) -> DataFrame:
    """Adds ``entry`` and ``score``.  Null and blank values get nulls; values that mean no entry get UNMATCHED.

    Of equally good entries the one later by name is taken.  An empty reference list leaves every value unmatched.  A list of
    more than ``block`` entries goes through the tasks block by block, with the word weights of the whole list.
    """
    require(values, column)
    names = sorted(wordings)
    blocks = [{k: wordings[k] for k in names[i : i + block]} for i in range(0, len(names), block)] or [{}]
    whole = frequencies(wordings) if len(blocks) > 1 else (None, None)
    got = [_mapper(b, threshold, *whole)(F.col(column)) for b in blocks]
    # An entry beats none; then the score decides, then the name.
    ranked = F.array_max(F.array(*[F.struct((g["entry"] != UNMATCHED).alias("found"), g["score"].alias("score"), g["entry"].alias("entry")) for g in got])) if len(got) > 1 else got[0]
    return values.withColumn("_m", ranked).withColumn("entry", F.col("_m.entry")).withColumn("score", F.col("_m.score")).drop("_m")


def free_metrics(facts: DataFrame, measures: DataFrame) -> DataFrame:
    """Facts whose metric is not blank and is no slug, label or alias as it stands: fact_id, slug (or UNMATCHED)."""
    require(facts, "fact_id", "metric")
    wordings = measure_wordings(measures)
    listed = measure_wordings(measures, {})
    stands = sorted({w.strip().lower() for ws in listed.values() for w in ws})
    value = F.lower(F.regexp_replace("metric", r"(?U)^\s+|\s+$", ""))
    free = facts.select("fact_id", "metric", value.alias("_v")).where("_v <> ''")
    if len(stands) <= 1000:
        free = free.where(~F.col("_v").isin(stands))
    else:
        free = free.join(facts.sparkSession.createDataFrame([(w,) for w in stands], "_v string"), "_v", "left_anti")
    return map_to_reference(free, "metric", wordings).select("fact_id", F.col("entry").alias("slug")).distinct()
