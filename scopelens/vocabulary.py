"""The words a report depends on. Everything here is a parameter of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Portuguese month abbreviations used in month labels.
MONTH_NAMES = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")

# Fixed value: what a spreadsheet shows for an invalid number.
NUMBER_ERROR = "#NÚM!"

# The order in which case types are reported.
TYPE_ORDER = (
    "CRÍTICA",
    "ELOGIO",
    "INFORMAÇÃO",
    "RECLAMAÇÃO",
    "SOLICITAÇÃO",
    "SUGESTÃO",
    "COMENTÁRIOS E MENÇÕES",
    "OUTRAS INTERAÇÕES",
)

# The colour of each case type in the breakdown, by its place in TYPE_ORDER.
TYPE_COLOURS = ("#FFD700", "#70AD47", "#5B9BD5", "red", "F4A460", "#FF66FF", "#008080", "#C0C0C0")

# The colour of a type-reason label, looked up by the type in front of ' - '.
PREFIX_COLOURS = {
    "Redes Sociais": "#008080",
    "Elogio": "#70AD47",
    "Solicitação": "#F4A460",
    "Informação": "#5B9BD5",
    "Manifestações Em Menor Volume": "#4F4F4F",
    "Crítica": "#FFD700",
    "Sugestão": "#FF66FF",
}
DEFAULT_COLOUR = "#4F4F4F"


@dataclass(frozen=True)
class Caption:
    """Text of a report caption. ``noun`` is None where the caption shows no total."""

    subject: str
    noun: str | None
    joiner: str = " a "


# Caption texts, by report. The line breaks belong to the text.
CAPTIONS = {
    "channel_evolution": Caption("Evolução das manifestações por canal\n", "manifestações"),
    "type_breakdown": Caption("Representatividade de tipos de ocorrência\n", "manifestações"),
    "complaint_pareto": Caption("10 principais motivos de reclamações \n", "reclamações"),
    "other_pareto": Caption("10 principais manifestações (exceto reclamações) \n", "manifestações", " - "),
    "category_brand": Caption("Total de manifestações por categoria \n", None),
    "line_variant": Caption("Total de manifestações por tipo de corte - 10 Principais Cortes \n", None),
    "subcat2": Caption("Total de manifestações por tipo de Subcategorias - 10 Principais manifestações \n", None),
}


@dataclass(frozen=True)
class Taxonomy:
    """Labels with a meaning of their own. The defaults are the Portuguese ones (fixed values)."""

    complaint: str = "Reclamação"
    social: str = "Redes Sociais"
    mention_groups: tuple[str, ...] = ("Comentários e Menções",)
    mentions_label: str = "COMENTÁRIOS E MENÇÕES"
    others_label: str = "OUTRAS INTERAÇÕES"
    unknown_label: str = "SEM GRUPO"
    type_order: tuple[str, ...] = TYPE_ORDER
    folded_reasons: tuple[tuple[str, str], ...] = (
        ("INFESTAÇÃO", "Infestação"),
        ("SABOR/ODOR ALTERADO", "Sabor/Odor Alterado"),
    )
    complaint_remainder: str = "Reclamações em menor volume"
    other_remainder: str = "Manifestações em menor volume"
    catch_all_brand: str = "EM GERAL"
    catch_all_label: str = "Não identificada"
    default_subcat1: str = "geral"
    default_subcat2: str = "EM GERAL"
    regular_line: str = "regular"
    default_line: str = "CORTES EM GERAL"
    month_names: tuple[str, ...] = MONTH_NAMES
    traditional_name: str = "Tradicionais"
    digital_name: str = "Digitais"
    captions: dict[str, Caption] = field(default_factory=lambda: dict(CAPTIONS))


PORTUGUESE = Taxonomy()
