"""Aircraft type lists and the type-to-category rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rule:
    """A category with the words that decide it, separated by blanks.

    A type fits if it contains a word of ``contains`` or equals one of
    ``equals``, contains none of ``excludes`` and matches ``pattern``.
    """

    category: str
    contains: str = ""
    equals: str = ""
    excludes: str = ""
    pattern: str = ""


# Category rules in order, the first that fits wins.
CATEGORY_RULES = (
    Rule("Airbus A320 Family", contains="A320 A321 A319 A20N", equals="A20N"),
    Rule("Airbus A350 Family", contains="A350 A35"),
    Rule("Airbus A330 Family", contains="A330 A33"),
    Rule("Airbus A380 Family", contains="A380 A38"),
    Rule("Airbus A220 Family", contains="A21", excludes="A20N"),
    Rule("Boeing 737 Family", contains="B738 B737 B38"),
    Rule("Boeing 787 Family", contains="B788 B789"),
    Rule("Boeing 777 Family", contains="B77"),
    Rule("Boeing 747 Family", contains="B74"),
    Rule("Boeing 767 Family", contains="B76"),
    Rule("Regional Jets", contains="RJ CRJ ERJ"),
    Rule("ATR Turboprops", contains="AT7 ATR"),
    Rule("De Havilland Canada", contains="DH8 DHC"),
    Rule("Saab Turboprops", contains="SF3 SAAB"),
    Rule("Business Jets", contains="C750 C700 C680 CIT C"),
    Rule("Business Jets", contains="PC12 PC24 PC21"),
    Rule("Business Jets", contains="GULF G550 G650 GLF"),
    Rule("Business Jets", contains="FALC FA50 FA900"),
    Rule("Business Jets", contains="LEAR LJ"),
    Rule("Business Jets", contains="HAWK HS"),
    Rule("Business Jets", contains="CHALL CL CL60"),
    Rule("Business Jets", contains="TBM TBM9"),
    Rule("Cessna Props", contains="C172 C152 C182 C208 C310 C337 C404"),
    Rule("Piper Aircraft", contains="PA28 PA32 PA44"),
    Rule("Diamond Aircraft", contains="DA40 DA42 DA62"),
    Rule("Beechcraft Aircraft", contains="BEECH BE BARON"),
    Rule("Mooney Aircraft", contains="MOONEY M20"),
    Rule("Military Aircraft", contains="F", pattern="^[A-Z][0-9]"),
    Rule("Military Aircraft", contains="F16 F18 F15"),
    Rule("Military Aircraft", contains="F35 F22"),
    Rule("Military Aircraft", contains="F111 F18S"),
    Rule("Military Aircraft", contains="C130 C17 C5"),
    Rule("Military Aircraft", contains="KC TANKER"),
    Rule("Military Aircraft", contains="P3 P8"),
    Rule("Military Aircraft", contains="MIG SU"),
    Rule("Military Aircraft", contains="MIR MIRAGE"),
    Rule("Military Aircraft", contains="TOR TORNADO"),
    Rule("Military Aircraft", contains="HAR HARRIER"),
    Rule("Military Aircraft", contains="CH UH AH"),
    Rule("Military Aircraft", contains="H60 UH60"),
    Rule("Military Aircraft", contains="PTS PARATROOPER"),
    Rule("Helicopters", contains="H HELI ROTOR R ROBIN ROBINSON GYRO AUTO"),
    Rule("Douglas Classic Aircraft", contains="DC3 DC6 DC9"),
    Rule("Concorde", contains="CONC CONCORDE"),
    Rule("Warbirds", contains="SPIT MUSTANG WARBIRD"),
    Rule("Gliders", contains="GLID SAILPLANE"),
    Rule("Lighter Than Air", contains="BALLOON AIRSHIP"),
    Rule("Beechcraft Baron", contains="B58"),
    Rule("Beechcraft King Air", contains="B350"),
    Rule("Airbus A300/A310", contains="A30", excludes="A20N"),
    Rule("Airbus A310", contains="A31"),
    Rule("Airbus A320 Variants", contains="A32"),
    Rule("Airbus A330 Variants", contains="A33"),
    Rule("Airbus A340 Variants", contains="A34"),
    Rule("Airbus A350 Variants", contains="A35"),
    Rule("Airbus A380 Variants", contains="A38"),
    Rule("Antonov An-225", contains="A225"),
    Rule("Embraer Regional Jets", contains="E1 E2 EMB"),
    Rule("Embraer ERJ Series", contains="ERJ E17 E19"),
    Rule("Bombardier Regional Jets", contains="CRJ CL"),
    Rule("Bombardier Q Series", contains="Q DASH"),
    Rule("ATR Turboprops", contains="ATR AT"),
    Rule("Fokker Aircraft", contains="FOKKER FK"),
    Rule("BAE Systems Aircraft", contains="BAE AVRO"),
    Rule("Cessna Aircraft", contains="CESS C"),
    Rule("Piper Aircraft", contains="PIPER PA"),
    Rule("Diamond Aircraft", contains="DIAM DA"),
    Rule("Beechcraft Aircraft", contains="BEECH BE"),
    Rule("Mooney Aircraft", contains="MOON M"),
    Rule("Grumman Aircraft", contains="GRUMM"),
    Rule("Grumman Aircraft", contains="AA", excludes="A2 A3 A4 A5 A6 A7 A8"),
    Rule("Bell Aircraft", contains="BELL BL"),
    Rule("Douglas Classic Aircraft", contains="DC"),
    Rule("Concorde", contains="CONC CONCORDE"),
    Rule("Warbirds", contains="SPIT MUSTANG WARBIRD"),
    Rule("Lockheed Classic Aircraft", contains="LOCK L"),
    Rule("Boeing Classic Aircraft", contains="BOE"),
    Rule("Experimental Aircraft", contains="EXP HOME BUILT"),
    Rule("Ultralight Aircraft", contains="ULTR LIGHT"),
    Rule("Agricultural Aircraft", contains="AG CROP DUST"),
    Rule("Utility Aircraft", contains="UTIL UTILITY"),
    Rule("Cargo Aircraft", contains="CARGO FREIGHT"),
    Rule("Seaplanes", contains="SEA FLOAT AMPH"),
    Rule("Gliders", contains="GLID SAIL SOAR"),
    Rule("Lighter Than Air", contains="BALLOON AIRSHIP BLIMP"),
    Rule("Cessna 172", equals="172 C172"),
    Rule("Cessna 152", equals="C152"),
    Rule("Cessna 182", equals="C182"),
    Rule("Cessna Caravan", equals="C208"),
    Rule("Cessna Citation", equals="C25C"),
    Rule("Cessna 310", equals="C310"),
    Rule("Cessna Skymaster", equals="C337"),
    Rule("Cessna 404", equals="C404"),
    Rule("Cessna Citation Mustang", equals="C510"),
    Rule("Cessna Citation Excel", equals="C56X"),
    Rule("Cessna Citation Longitude", equals="C700"),
    Rule("Cessna Citation X", equals="C750"),
    Rule("Bombardier Challenger", equals="CL60"),
    Rule("Piper PA-28", equals="P28A"),
    Rule("Piper PA-24", equals="PA24"),
    Rule("Piper PA-44", equals="PA44"),
    Rule("Diamond DA40", equals="DA40"),
    Rule("Diamond DA42", equals="DA42"),
    Rule("Diamond DA50", equals="DA50"),
    Rule("Diamond DA62", equals="DA62"),
    Rule("Beechcraft King Air", equals="BE10"),
    Rule("Beechcraft Bonanza", equals="BE36"),
    Rule("Beechcraft Baron", equals="BE58"),
    Rule("Beechcraft King Air", equals="BE9L"),
    Rule("Pilatus PC-12", equals="PC12"),
    Rule("Pilatus PC-21", equals="PC21"),
    Rule("Pilatus PC-24", equals="PC24"),
    Rule("TBM TBM-900", equals="TBM9"),
    Rule("Cirrus SR22", equals="SR22"),
    Rule("MX Aircraft MXS", equals="MXS"),
    Rule("Cirrus SR22T", equals="S22T"),
    Rule("Fairchild Swearingen", equals="SW4"),
    Rule("Let L-410", equals="L410"),
    Rule("Saab 340", equals="SF34"),
    Rule("Cirrus Vision SF50", equals="SF50"),
    Rule("Embraer E190", equals="E190"),
    Rule("Embraer E300", equals="E300"),
    Rule("Embraer Phenom", equals="E50P"),
    Rule("Eurocopter EC145", equals="EC45"),
    Rule("Eurocopter AS350", equals="AS50"),
    Rule("Sikorsky H-60", equals="H60"),
    Rule("Sikorsky UH-60", equals="UH60"),
    Rule("General Dynamics F-111", equals="F111"),
    Rule("McDonnell Douglas F-18", equals="F18S"),
    Rule("Lockheed Martin F-35", equals="F35"),
    Rule("Gulfstream G650", equals="GLF6"),
    Rule("Concorde", equals="CONC"),
    Rule("Paratrooper Aircraft", equals="PTS1"),
    Rule("Avro RJ70", equals="RJ70"),
    Rule("Boeing P-8 Poseidon", equals="P8"),
    Rule("Antonov An-225", equals="A225"),
)
OTHER_CATEGORY = "Other Aircraft"


def _fits(kind: Column, rule: Rule) -> Column:
    hits = [kind.contains(w) for w in rule.contains.split()] + [kind == w for w in rule.equals.split()]
    needs = [~kind.contains(w) for w in rule.excludes.split()] + ([kind.rlike(rule.pattern)] if rule.pattern else [])
    return reduce(lambda a, b: a & b, needs, reduce(lambda a, b: a | b, hits))


def aircraft_category(kind: Column) -> Column:
    """The rule list folded into one CASE."""
    out = None
    for rule in CATEGORY_RULES:
        test = _fits(kind, rule)
        out = F.when(test, F.lit(rule.category)) if out is None else out.when(test, F.lit(rule.category))
    return out.otherwise(F.lit(OTHER_CATEGORY))


# Types left out of the ground speed ranking.
SPEED_EXCLUDED = (
    "CONC", "TU144", "TU160", "MIG21", "MIG23", "MIG25", "MIG29", "MIG31", "SU27", "SU30", "SU33", "SU35", "SU57",
    "F14", "F15", "F16", "F18", "F22", "F35", "TYPH", "RAF", "GRIP", "MIR2", "MIR4", "HAR", "JAG", "TORN", "VIGG",
    "M2K", "RAPH", "EF2K", "GR4", "FGR4", "F4", "F5", "A4", "A6", "A7", "F111", "F117", "B1", "B2", "SR71", "U2",
    "TR1", "C550", "C560", "C680", "C750", "C850", "BE20", "BE30", "BE40", "BE90", "BE99", "GLF4", "GLF5", "GLF6",
    "GLF7", "FAL7", "FAL8", "FAL9", "FAL0", "LJ35", "LJ45", "LJ60", "LJ75", "CL30", "CL60", "CL65", "CL85", "GL5T",
    "GL6T", "GL7T", "GL8T", "E135", "E145", "E170", "E175", "E190", "E195", "AT72", "AT76", "AT42", "AT45", "DH8A",
    "DH8B", "DH8C", "DH8D", "DH8Q", "B350", "B190", "B200", "B300", "B360", "PC12", "PC21", "PC24", "AN24", "AN26",
    "AN32", "AN72", "AN74", "SF34", "SF50", "DHC6", "DHC7", "DHC8", "K350", "EMB1", "EMB2", "EMB3", "EMB4", "EMB5",
)
SPEED_EXCLUDED_PREFIXES = ("F-", "MIG", "SU-", "TU-", "MIR")


def speed_excluded(kind: Column) -> Column:
    test = kind.isin(*SPEED_EXCLUDED)
    for prefix in SPEED_EXCLUDED_PREFIXES:
        test = test | kind.startswith(prefix)
    return test
