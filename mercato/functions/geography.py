"""State codes of Brazil, their names and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states of each region, code to name.
REGIONS = {
    "North": {
        "AC": "Acre",
        "AM": "Amazonas",
        "AP": "Amapá",
        "PA": "Pará",
        "RO": "Rondônia",
        "RR": "Roraima",
        "TO": "Tocantins",
    },
    "Northeast": {
        "AL": "Alagoas",
        "BA": "Bahia",
        "CE": "Ceará",
        "MA": "Maranhão",
        "PB": "Paraíba",
        "PE": "Pernambuco",
        "PI": "Piauí",
        "RN": "Rio Grande do Norte",
        "SE": "Sergipe",
    },
    "Central-West": {
        "DF": "Distrito Federal",
        "GO": "Goiás",
        "MS": "Mato Grosso do Sul",
        "MT": "Mato Grosso",
    },
    "Southeast": {
        "ES": "Espírito Santo",
        "MG": "Minas Gerais",
        "RJ": "Rio de Janeiro",
        "SP": "São Paulo",
    },
    "South": {
        "PR": "Paraná",
        "RS": "Rio Grande do Sul",
        "SC": "Santa Catarina",
    },
}
UNKNOWN = "Unknown"

STATE_NAMES = {code: name for states in REGIONS.values() for code, name in states.items()}
STATE_REGIONS = {code: region for region, states in REGIONS.items() for code in states}


def _look_up(code: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(text) for pair in table.items() for text in pair])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(UNKNOWN))


def state_name(code: Column) -> Column:
    return _look_up(code, STATE_NAMES)


def region_of(code: Column) -> Column:
    return _look_up(code, STATE_REGIONS)
