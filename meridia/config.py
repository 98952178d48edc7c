"""Rules as frozen values. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The exam's income letters, limits and midpoints in minimum wages (open above: None).
INCOME_BANDS: tuple[tuple[str, float, float | None, float], ...] = (
    ("A", 0, 0, 0),
    ("B", 0, 1, 0.5),
    ("C", 1, 1.5, 1.25),
    ("D", 1.5, 2, 1.75),
    ("E", 2, 2.5, 2.25),
    ("F", 2.5, 3, 2.75),
    ("G", 3, 4, 3.5),
    ("H", 4, 5, 4.5),
    ("I", 5, 6, 5.5),
    ("J", 6, 7, 6.5),
    ("K", 7, 8, 7.5),
    ("L", 8, 9, 8.5),
    ("M", 9, 10, 9.5),
    ("N", 10, 12, 11),
    ("O", 12, 15, 13.5),
    ("P", 15, 20, 17.5),
    ("Q", 20, None, 25),
)

# Minimum wage in currency by exam year.
MINIMUM_WAGE = {2023: 1320.0, 2024: 1412.0, 2025: 1518.0}

#: Income per head up to this many minimum wages is low.
LOW_INCOME = 1.5

# School network codes by source, as (group, detail).
NETWORK_MAPS: dict[str, dict[object, tuple[str | None, str | None]]] = {
    "exam_dependency": {1: ("publica", "federal"), 2: ("publica", "estadual"), 3: ("publica", "municipal"), 4: ("privada", "privada")},
    "exam_self_report": {2: ("publica", None), 3: ("privada", "privada")},
    "assessment": {"publica": ("publica", None), "privada": ("privada", "privada")},
    "index": {
        "Federal": ("publica", "federal"),
        "Estadual": ("publica", "estadual"),
        "Municipal": ("publica", "municipal"),
        "Pública": ("publica", None),
        "Privada": ("privada", "privada"),
    },
    "awards": {"F": ("publica", "federal"), "E": ("publica", "estadual"), "M": ("publica", "municipal"), "P": ("privada", "privada"), "C": (None, "outra")},
}

# School stage by (competition, modality or None, level or None for any).
STAGE_RULES: tuple[tuple[str, str | None, str | None, str], ...] = (
    ("OBMEP", None, "1", "EF2"),
    ("OBMEP", None, "2", "EF2"),
    ("OBMEP", None, "3", "EM"),
    ("OCMAT", None, "1", "EF2"),
    ("OCMAT", None, "2", "EF2"),
    ("OCMAT", None, "3", "EM"),
    ("OCMAT", None, "4", "EM"),
    ("OBI", "Iniciação", "Júnior", "EF1"),
    ("OBI", "Iniciação", "1", "EF2"),
    ("OBI", "Iniciação", "2", "EF2"),
    ("OBI", "Programação", "Júnior", "EF2"),
    ("OBI", "Programação", "1", "EF2_EM"),
    ("OBI", "Programação", "2", "EF2_EM"),
    ("OBI", "Programação", "Sênior", "tecnico_superior"),
    ("OBI", "Universitária", None, "superior"),
)
#: Modality prefix of the women's edition, which maps like the edition without it.
MODALITY_PREFIX = "CF-OBI "
IN_SCOPE = ("EF2", "EM", "EF2_EM")
UPPER_SECONDARY = ("EM", "tecnico_superior", "superior")
MIXED_STAGE = "EF2_EM"
#: Exam completion codes that count as finishing upper-secondary school.
COMPLETION_CODES = (1, 2)
MEDALS = ("Ouro", "Prata", "Bronze", "Menção Honrosa")

# Names that mark a school as upper-secondary.
UPPER_SECONDARY_NAMES = (
    r"INSTITUTO FEDERAL",
    r"\bIF[A-Z]*\b",
    r"CEFET",
    r"\bETEC\b",
    r"\bETE\b",
    r"TECNIC",
    r"ENSINO MEDIO",
    r"ESCOLA ESTADUAL",
    r"COLEGIO ESTADUAL",
    r"CENTRO ESTADUAL",
    r"\bEEEM\b",
    r"\bEEEP\b",
    r"\bCEEP\b",
    r"\bEEM\b",
    r"COLEGIO MILITAR",
    r"COLEGIO DE APLICACAO",
    r"SENAI",
    r"LICEU",
)

# Abbreviations in school names.
ABBREVIATIONS = {
    "EE": "ESCOLA ESTADUAL",
    "EEEF": "ESCOLA ESTADUAL ENSINO FUNDAMENTAL",
    "EEEFM": "ESCOLA ESTADUAL ENSINO FUNDAMENTAL MEDIO",
    "EEEM": "ESCOLA ESTADUAL ENSINO MEDIO",
    "EEF": "ESCOLA ESTADUAL ENSINO FUNDAMENTAL",
    "EEM": "ESCOLA ESTADUAL ENSINO MEDIO",
    "EMEF": "ESCOLA MUNICIPAL ENSINO FUNDAMENTAL",
    "EMEI": "ESCOLA MUNICIPAL EDUCACAO INFANTIL",
    "EMEIEF": "ESCOLA MUNICIPAL EDUCACAO INFANTIL ENSINO FUNDAMENTAL",
    "EMEB": "ESCOLA MUNICIPAL EDUCACAO BASICA",
    "EMEFM": "ESCOLA MUNICIPAL ENSINO FUNDAMENTAL MEDIO",
    "CIEP": "CENTRO INTEGRADO EDUCACAO PUBLICA",
    "CEF": "CENTRO ENSINO FUNDAMENTAL",
    "CEM": "CENTRO ENSINO MEDIO",
    "CETI": "CENTRO ENSINO TEMPO INTEGRAL",
    "COL": "COLEGIO",
    "COLEG": "COLEGIO",
    "ESC": "ESCOLA",
    "EST": "ESTADUAL",
    "ESTAD": "ESTADUAL",
    "MUN": "MUNICIPAL",
    "MUNIC": "MUNICIPAL",
    "FED": "FEDERAL",
    "PART": "PARTICULAR",
    "PROF": "PROFESSOR",
    "PROFA": "PROFESSORA",
    "DR": "DOUTOR",
    "DRA": "DOUTORA",
    "CEL": "CORONEL",
    "STA": "SANTA",
    "STO": "SANTO",
    "INST": "INSTITUTO",
    "IF": "INSTITUTO FEDERAL",
    "EF": "ENSINO FUNDAMENTAL",
    "EMI": "ENSINO MEDIO INTEGRADO",
    "FUND": "FUNDAMENTAL",
    "EREM": "ESCOLA REFERENCIA ENSINO MEDIO",
    "ECIT": "ESCOLA CIDADA INTEGRAL TECNICA",
    "CE": "COLEGIO ESTADUAL",
    "MUL": "MUNICIPAL",
    "ENG": "ENGENHEIRO",
    "UNID": "UNIDADE",
    "GEN": "GENERAL",
    "EXERC": "EXERCITO",
    "SEN": "SENADOR",
    "GOV": "GOVERNADOR",
    "DEP": "DEPUTADO",
    "PRES": "PRESIDENTE",
    "DESEMB": "DESEMBARGADOR",
    "ENS": "ENSINO",
    "FUN": "FUNDAMENTAL",
    "NS": "NOSSA SENHORA",
    "SRA": "SENHORA",
    "SR": "SENHOR",
}
#: Expanded as the first token only.
LEADING_ABBREVIATIONS = {"EM": "ESCOLA MUNICIPAL"}

# Words that say nothing about which school it is.
GENERIC_WORDS = (
    "ESCOLA", "ESTADUAL", "MUNICIPAL", "FEDERAL", "PARTICULAR", "PRIVADA", "PUBLICA", "ENSINO", "FUNDAMENTAL", "MEDIO",
    "INFANTIL", "EDUCACAO", "BASICA", "COLEGIO", "CENTRO", "INTEGRADO", "INSTITUTO", "TECNICO", "PROFISSIONAL",
    "PROFESSOR", "PROFESSORA", "DOUTOR", "DOUTORA", "E", "DE", "DA", "DO", "DAS", "DOS", "EM", "EF", "EEF", "EEM", "EMEF",
    "EE", "CE", "CM", "EB", "ESC", "UNIDADE", "ANEXO", "TEMPO", "INTEGRAL", "NIVEL", "GRAU", "1O", "2O", "CAMPUS", "NA", "O", "A",
)

# Roman numerals from two on, and network words, in school names.
ROMAN = ("II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
DEPENDENCY_WORDS = ("ESTADUAL", "MUNICIPAL", "FEDERAL")

# Metric columns of the school index sheets, VL_<key>_<year> and VL_APROVACAO_<year>_<key>.
INDEX_METRICS = {
    "INDICADOR_REND": "indicador_rendimento",
    "NOTA_MATEMATICA": "nota_saeb_mt",
    "NOTA_PORTUGUES": "nota_saeb_lp",
    "NOTA_MEDIA": "nota_saeb_padronizada",
    "OBSERVADO": "ideb",
    "PROJECAO": "ideb_projecao",
}
PASS_RATE_METRICS = {"SI_4": "taxa_aprovacao", "1": "taxa_aprovacao_s1", "2": "taxa_aprovacao_s2", "3": "taxa_aprovacao_s3", "4": "taxa_aprovacao_s4"}
NOT_AVAILABLE = ("-", "--", "", "ND", "ND***")

# State codes of the census bureau.
STATE_CODES = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP", 41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}


@dataclass(frozen=True)
class Suppression:
    default: int = 10
    awards: int = 1
    by_table: dict[str, int] = field(default_factory=dict)

    def n_min(self, table: str | None = None) -> int:
        return self.by_table.get(table, self.default)


@dataclass(frozen=True)
class LinkRules:
    auto: float = 90.0
    review: float = 80.0
    tie: float = 2.0
    secondary_tie: float = 5.0
    top: int = 3
    core_sort: float = 60.0
    core_set: float = 85.0
    core_length: float = 0.5
    use_network: bool = True
    subset_guard: bool = True
    number_guard: bool = True
    dependency_guard: bool = True


@dataclass(frozen=True)
class IndexRules:
    """Weights, signs and shrinkage of the composite index."""

    weights: tuple[tuple[str, float], ...] = (("talent", 0.5), ("quality", 0.2), ("vulnerability", 0.3))
    quality_sign: int = 1
    income_n: float = 30.0
    talent_population: float = 20_000.0
    min_components: int = 3
    n_min_published: int = 10
