"""Small authored inputs with the results that the rules give, for branches that the driver's tables do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: id, line, cleaned
LINES = [
    (1, "  The   harbour  was  closed. ", "The harbour was closed."), (2, "   ", ""), (3, "42", None), (4, "CHAPTER ONE", None), (5, "FM 7-0", None), (6, "12 March 2021", None),
    (7, "THE HARBOUR MASTER", None), (8, "THE HARBOUR MASTER KEEPS A LOG", "THE HARBOUR MASTER KEEPS A LOG"), (9, "a re- port is kept", "a report is kept"), (10, "sof­t hyphen", "soft hyphen"), (11, "Section Two", None),
    (12, "the oﬃce keeps ½ a log", "the office keeps 1⁄2 a log"), (13, "an a- b- c of ports", "an abc of ports"), (14, "the\u00a0port\u2003is open", "the port is open"), (15, "ﬁfty é- tages", "fifty étages"),
]
#: term, spaced, article, plural phrase, its singular
TERMS = [
    ("HarbourMaster", "harbour master", "a", "harbour masters", "harbour master"), ("Estuary", "estuary", "an", "wide estuaries", "wide estuary"), ("OreShip", "ore ship", "an", "boxes", "box"), ("Ferry", "ferry", "a", "the crews", "the crew"), ("Glass", "glass", "a", "glass", "glass"),
    ("Analysis", "analysis", "an", "port analysis", "port analysis"), ("Size", "size", "a", "hull sizes", "hull size"), ("Tie", "tie", "a", "ties", "tie"), ("Walrus", "walrus", "a", "old Walrus", "old Walrus"), ("Bus", "bus", "a", "HARBOUR BUSES", "HARBOUR BUS"),
]
#: id, sentence, reason, subject, head
DEFINITIONS = [
    (1, "A ferry is a vessel that crosses water.", None, "A ferry", "vessel"), (2, "Within the port, a pilot is a guide.", "leading_scope", None, None), (3, "A pilot is not a captain.", "condition_negation_or_disjunction", None, None),
    (4, "Pilots guide ships into port.", "no_simple_definition_head", None, None), (5, "A hull is part of a ship.", "non_kind_predicate", None, None), (6, "The gate is closed at night.", "non_kind_predicate", None, None), (7, "Pilots are guides.", None, "Pilots", "guides"),
]
#: id, sentence, parts
COMPOUNDS = [
    (1, "The ferry sails; the pilot waits", "The ferry sails.|The pilot waits."), (2, "The ferry, which crosses the bay, carries cars.", "The ferry carries cars.|The ferry crosses the bay."),
    (3, "The ferry sails; or the pilot waits.", "The ferry sails; or the pilot waits."), (4, "The ferry sails.", "The ferry sails."),
    (5, "The ferry sails, and the pilot waits.", "The ferry sails.|The pilot waits."), (6, "The ferry and the pilot wait.", "The ferry and the pilot wait."), (7, "The ferry sails; the tug pulls and the crew rests", "The ferry sails.|The tug pulls.|The crew rests."),
    (8, "The ferry, which is old, sails and the tug, which is new, pulls.", "The ferry sails.|The tug pulls.|The ferry sails.|The tug is new.|The ferry is old."), (9, "The ferry sails but never at night.", "The ferry sails but never at night."), (10, None, ""), (11, " ;, ", ""),
]
#: id, text, linked text, over KNOWN and two abbreviations, of which one names no class
LINKED = [
    (1, "the FERRY meets a cargoship.", "the Ferry meets a CargoShip."), (2, "a ferry-boat is no Ferry", "a ferry-boat is no Ferry"), (3, "HP and XX wait in port", "HarbourPilot and XX wait in Port"), (4, "", ""), (5, None, None), (6, "Ports", "Ports"),
]
#: id, sentence, and what comes of it: subclaim, route, reason, cnl
INGESTED = [
    (1, "A tug is a vessel; the fleet consists of ferries and tugs.", [("A Tug is a Vessel.", "reject", "abstained", None), ("The Fleet consists of ferries and tugs.", "review", "unverified_subclass_direction", "Ferry subclass-of Fleet Tug subclass-of Fleet")]), (9, "The fleet consists of ferries and tugs.", [("The Fleet consists of ferries and tugs.", "accepted", None, "Ferry subclass-of Fleet Tug subclass-of Fleet")]), (2, "The guides relation holds between a pilot and a tug.", [("The guides relation holds between a Pilot and a Tug.", "accepted", None, "guides Pilot Tug")]),
    (3, "The guides relation holds between a process and a pilot.", [("The guides relation holds between a Process and a Pilot.", "review", "weak_argument", "guides Process Pilot")]), (4, "See FM 3-0 for the harbour pilots.", [("See FM 3-0 for the harbour pilots.", "reject", "noise", None)]), (5, "It waits in the port.", [("It waits in the Port.", "reject", "abstained", None)]),
    (6, "A tug can be located in a port, and the pilot sleeps.", [("A Tug can be located in a Port.", "review", "unverified_scope", "located Tug Port"), ("The Pilot sleeps.", "reject", "abstained", None)]), (7, None, [("", "reject", "noise", None)]), (8, "The between relation holds between a pilot and a tug.", [("The between relation holds between a Pilot and a Tug.", "reject", "compile_error", "between Pilot Tug")]),
]
CLASSES = [(k + 1, t) for k, t in enumerate(["Vessel", "Ferry", "Pilot", "Port", "HarbourMaster", "Agent", "Cargo", "OreShip"])]
RELATIONS = [("guides", 2), ("located", 2), ("between", 3), ("loose", None)]
#: id, cnl, kif, kind of error, kind when closed, pattern
CNL = [
    (1, "?x is-a Ferry.", "(instance ?x Ferry)", "valid", "free variable", "instance"), (2, "Ferry subclass-of Vessel", "(subclass Ferry Vessel)", "valid", "valid", "subclass"), (3, "guides Pilot Ferry.", "(guides Pilot Ferry)", "valid", "valid", "relation"),
    (4, "between [ Port , Ferry , Cargo ]", "(between Port Ferry Cargo)", "valid", "valid", "nary"), (5, "not guides Pilot Cargo", "(not (guides Pilot Cargo))", "valid", "valid", "negation"),
    (6, "every ?x is-a Ferry implies guides Pilot ?x", "(forall (?x) (=> (instance ?x Ferry) (guides Pilot ?x)))", "valid", "valid", "conditional"), (7, "some ?x is-a Port", "(exists (?x) (instance ?x Port))", "valid", "valid", "existential"),
    (8, "no ?x is-a Ferry implies located ?x Cargo", "(forall (?x) (=> (instance ?x Ferry) (not (located ?x Cargo))))", "valid", "valid", "conditional"), (9, "if ?x is-a Ferry and guides Pilot ?x then located ?x Port", "(=> (and (instance ?x Ferry) (guides Pilot ?x)) (located ?x Port))", "valid", "free variable", "conditional"),
    (10, "?x is-a Submarine", None, "unknown class", "unknown class", "instance"), (11, "tows Ferry Vessel", None, "unknown relation", "unknown relation", "relation"), (12, "between Port Ferry", None, "arity", "arity", "relation"),
    (13, "loose [ Port , Ferry , Cargo , Pilot ]", "(loose Port Ferry Cargo Pilot)", "valid", "valid", "nary"), (14, "guides Pilot", None, "syntax", "syntax", "relation"), (15, "no ?x is-a Cargo", "(forall (?x) (not (instance ?x Cargo)))", "valid", "valid", "conditional"), (16, "Ferry subclass-of Vessel.\nPilot subclass-of Agent.", "(subclass Ferry Vessel)\n(subclass Pilot Agent)", "valid", "valid", "subclass"),
]
#: id, cnl, source, relations, classes, pattern, reason
GATE = [
    (1, "Ferry subclass-of Vessel", "A ferry is a vessel.", "", "Ferry,Vessel", "subclass", None), (2, "Ferry subclass-of Ferry", "A ferry is a ferry.", "", "Ferry", "subclass", "degenerate_form"), (3, "Ferry subclass-of Vessel", "Ferries cross the bay.", "", "Ferry,Vessel", "subclass", "weak_grounding"),
    (4, "Vessel subclass-of Ferry", "A ferry is a vessel.", "", "Vessel,Ferry", "subclass", "unverified_subclass_direction"), (5, "Ferry subclass-of Vessel", "Vessels consist of tugs and ferry.", "", "Ferry,Vessel", "subclass", None), (6, "?x is-a Pilot", "The man is a pilot.", "", "Pilot", "instance", None),
    (7, "?x is-a Pilot", "Pilots work hard.", "", "Pilot", "instance", "weak_grounding"), (8, "some ?x is-a Port", "There is a port near the bay.", "", "Port", "existential", None), (9, "some ?x is-a Port", "The port is busy.", "", "Port", "existential", "weak_grounding"),
    (10, "guides ?x ?y", "It guides things.", "guides", "", "relation", "degenerate_form"), (11, "guides Pilot Unit", "A pilot guides a unit.", "guides", "Pilot,Unit", "relation", "weak_argument"), (12, "guides Pilot Ferry", "A pilot leads a ferry.", "guides", "Pilot,Ferry", "relation", "ungrounded_relation"),
    (13, "guides Pilot Cargo", "A pilot guides a ferry.", "guides", "Pilot,Cargo", "relation", "ungrounded_class_terms"), (14, "guides Pilot Ferry", "A pilot may guides a ferry.", "guides", "Pilot,Ferry", "relation", "unverified_scope"), (15, "between [ Port , Ferry ]", "The port is between a ferry.", "between", "Port,Ferry", "nary", "degenerate_form"),
    (16, "not Ferry subclass-of Vessel", "A ferry is a vessel.", "", "Ferry,Vessel", "negation", "unverified_subclass_direction"), (17, "guides Pilot Ferry", "A pilot guides a ferry.", "guides", "Pilot,Ferry", "relation", None),
    (18, "Ferry subclass-of Vessel Tug subclass-of Tug", "A ferry is a vessel and a tug.", "", "Ferry,Vessel,Tug", "subclass", "degenerate_form"), (19, "Ferry subclass-of Vessel Vessel subclass-of Tug", "A ferry is a vessel and a tug.", "", "Ferry,Vessel,Tug", "subclass", "unverified_subclass_direction"),
    (20, "Ferry subclass-of Fleet Tug subclass-of Fleet", "The fleet consists of ferries and tugs.", "", "Ferry,Fleet,Tug", "subclass", None), (21, "guides Pilot Mission", "A pilot guides a mission.", "guides", "Pilot,Mission", "relation", "weak_argument"), (22, "guides Pilot Group", "A pilot guides a group.", "guides", "Pilot,Group", "relation", None),
    (23, "guides Pilot Estuary", "A pilot guides in estuaries.", "guides", "Pilot,Estuary", "relation", None), (24, "states Pilot UnitedStates", "A pilot states the united states.", "states", "Pilot,UnitedStates", "relation", "weak_argument"), (25, "guides Pilot UnitedStates", "A pilot guides the united states.", "guides", "Pilot,UnitedStates", "relation", None),
    (26, "guides Pilot Watercraft", "A pilot guides a small boat.", "guides", "Pilot,Watercraft", "relation", None), (27, "Tug subclass-of Vessel", "A tug is a strong boat.", "", "Tug,Vessel", "subclass", None), (28, "Tug subclass-of Vessel", "Tugs tow ships.", "", "Tug,Vessel", "subclass", "weak_grounding"),
    (29, "Pilot subclass-of Procedure", "A pilot is a guide.", "", "Pilot,Procedure", "subclass", "ungrounded_class_terms"), (30, "some ?x is-a OreShip", "At least one ore-ship exists.", "", "OreShip", "existential", None), (31, "guides Pilot Ferry", None, "guides", "Pilot,Ferry", "relation", "ungrounded_relation"),
    (32, "Ferry subclass-of Vessel", "Ferries are the vessels of the bay.", "", "Ferry,Vessel", "subclass", "unverified_subclass_direction"), (33, "guides Glass Bus", "Glasses and buses: it guides them.", "guides", "Glass,Bus", "relation", None),
]
#: file, line, text
KIF = [
    ("a.kif", 1, "(subclass Ferry Vessel)"), ("a.kif", 2, "; (subclass Port Vessel)"), ("a.kif", 3, "  (subclass Tug Vessel)"), ("a.kif", 4, "(subclass Ferry Craft) ; later parent"), ("b.kif", 1, "(and (subclass Pilot Agent) (subclass Cook Agent))"), ("b.kif", 2, "(subclass Port Place)"),
    ("b.kif", 3, "(domain guides 1 Pilot)"), ("b.kif", 4, "(domain guides 2 Ferry)"), ("b.kif", 5, "(domainSubclass guides 2 Vessel)"), ("b.kif", 6, "(domain located 1 Cargo)"), ("b.kif", 7, "(domainSubclass located 2 Port)"), ("b.kif", 8, "(domain guides 2 Vessel)"),
    ("a.kif", 9, "( domain located 1 Pilot )"), ("a.kif", 10, "(range weighs Number)"), ("b.kif", 9, "(rangeSubclass weighs Mass)"), ("b.kif", 10, "(domainSubclass weighs 1 Vessel)"), ("b.kif", 11, "(domainSubclass weighs 1 Tug)"), ("b.kif", 12, "(instance weighs UnaryFunction)"), ("b.kif", 13, "(instance guides BinaryPredicate)"),
    ("b.kif", 14, "(subrelation tows guides)"), ("b.kif", 15, "(subrelation lost nowhere)"), ("b.kif", 16, "(instance Ada Ferry)"), ("b.kif", 17, "(instance guides TransitiveRelation)"),
]
FACTS = [(k, x) for k, x in enumerate([
    "(subclass Ferry Vessel)", "(subclass Vessel Craft)", "(instance Ada Ferry)", "(not (subclass Ferry Building))", "(instance Bob Pilot)", "(not (instance Bob Ghost))", "(subclass Craft Thing)",
])]
#: id, question, status
QUESTIONS = [
    (1, "(subclass Ferry Craft)", "proven"), (2, "(instance Ada Thing)", "proven"), (3, "(not (subclass Ferry Building))", "proven"), (4, "(subclass Ferry Building)", "disproven"), (5, "(subclass Vessel Building)", "disproven"), (6, "(subclass Pilot Ghost)", "disproven"), (7, "(instance Bob Ferry)", "unknown"),
    (8, "(subclass Building Ferry)", "unknown"), (9, "(instance Zed Ferry)", "unknown"), (10, "(not (instance Ada Craft))", "disproven"), (11, "(likes Ada Bob)", "unknown"), (12, "(subclass Ferry Ferry)", "unknown"), (13, "(instance Bob Ghost)", "disproven"),
]
KNOWN = [(t,) for t in ["Process", "IntelligenceProduct", "Vessel", "Ferry", "Tug", "Pilot", "Port", "AutonomousAgent", "CargoShip", "HarbourPilot", "Fleet"]]
PARENTS = "Process,IntelligenceProduct,Vessel,Nowhere"
#: id, cnl, passage, evidence, symbol, alias, cue, reason
DECLARED = [
    (1, "DredgingProcess subclass-of Process", "Dredging is the process of clearing mud. It is slow.", "Dredging is the process of clearing mud.", "DredgingProcess", "Dredging", "is the", None), (2, "every ?x is-a Ferry", "Dredging is the process.", "Dredging is the process.", "DredgingProcess", "Dredging", "is the", "not_single_subclass"),
    (3, "Process subclass-of DredgingProcess", "Dredging is the process.", "Dredging is the process.", "DredgingProcess", "Dredging", "is the", "reversed_direction"), (4, "Ferry subclass-of Process", "Dredging is the process.", "Dredging is the process.", "DredgingProcess", "Dredging", "is the", "undeclared_child"),
    (5, "DredgingProcess subclass-of Nowhere", "Dredging is the process.", "Dredging is the process.", "DredgingProcess", "Dredging", "is the", "parent_not_existing_class"), (6, "DredgingProcess subclass-of Process", "Mud is wet.", "Dredging is the process.", "DredgingProcess", "Dredging", "is the", "evidence_not_in_passage"),
    (7, "DredgingProcess subclass-of Process", "The crew likes dredging.", "The crew likes dredging.", "DredgingProcess", "Dredging", "is the", "declaration_phrase_not_subject"), (8, "DredgingProcess subclass-of Process", "Dredging is a process.", "Dredging is a process.", "DredgingProcess", "Dredging", "is the", "declaration_sense_not_in_passage"),
    (9, "DredgingWork subclass-of Process", "Dredging is the process of clearing mud.", "Dredging is the process of clearing mud.", "DredgingWork", "Dredging", "is the", "symbol_sense_mismatch"), (10, "SonarIntelligence subclass-of IntelligenceProduct", "Sonar is intelligence derived from echoes.", "Sonar is intelligence derived from echoes.", "SonarIntelligence", "Sonar", "is", "ambiguous_genus_sense"),
    (11, "Barge subclass-of Vessel", "A barge is a flat vessel.", "A barge is a flat vessel.", "Barge", "barge", "is a", "unstated_parent"), (12, "Barge subclass-of Vessel", "A barge is a vessel that may carry sand.", "A barge is a vessel that may carry sand.", "Barge", "barge", "is a", "unverified_scope"), (13, "Barge subclass-of Vessel", "Barges are the vessels of the bay.", "Barges are the vessels of the bay.", "Barges", "Barges", "are the", "undeclared_child"),
    (14, "Barges subclass-of Vessel", "Barges are the vessels of the bay.", "Barges are the vessels of the bay.", "Barges", "Barges", "are the", None), (15, "SonarIntelligence subclass-of IntelligenceProduct", "Sonar is intelligence that is produced at sea.", "Sonar is intelligence that is produced at sea.", "SonarIntelligence", "Sonar", "is", None),
]
#: seq, candidate, evidence, symbol, genus, parents, kept
PROPOSED = [
    (1, "Dredging is the process", "Dredging is the process of clearing mud.", "DredgingProcess", "process", "Process", True), (2, "Risk control is the primary process", "Risk control is the primary process for ports.", None, None, None, None), (3, "This is a vessel", "This is a vessel.", None, None, None, None),
    (4, "A barge is a vessel", "A barge is a vessel and boat.", None, None, None, None), (5, "A hull is a part", "A hull is a part of a ship.", None, None, None, None), (6, "The barge is a vessel", "The barge is a flat vessel of the bay.", "BargeVessel", "flat vessel", "Process,Vessel", True), (7, "A barge is a boat", "A barge is a boat of the bay.", "BargeBoat", "boat", "Process", False),
    (8, "A barge boat is a boat", "A barge boat is a boat.", "BargeBoat", "boat", "Process", True), (9, "A ferry is a vessel", "A ferry is a vessel.", None, None, None, None), (10, "Mooring is useful", "Mooring is useful to ships.", None, None, None, None),
]
#: id, text, template, cnl. In row 9 an earlier frame fits, with "tug does not" as its slot, so the negation is lost: the order of the frames decides, and the gate refuses it by its scope word.
ROUTED = [
    (1, "For every ferry, the guides relation holds with a pilot.", "conditional_every", "every ?x is-a Ferry implies guides ?x Pilot"), (2, "Every ferry has an autonomous agent.", "conditional_every", "every ?x is-a Ferry implies agent ?x AutonomousAgent"), (3, "Every ferry has a pilot as its agent.", "conditional_every", "every ?x is-a Ferry implies agent ?x Pilot"), (4, "Every ferry has a pilot.", None, None),
    (5, "The guides relation holds between a pilot and a ferry.", "binary", "guides Pilot Ferry"), (6, "A tug can have a port as its destination.", "binary", "destination Tug Port"), (7, "A ferry can be located in a port.", "binary", "located Ferry Port"), (8, "It is not the case that the guides relation holds between a pilot and a tug.", "negation_binary", "not guides Pilot Tug"), (9, "A tug does not have a pilot as its agent.", "binary", "agent Tug Pilot"),
    (10, "A tug is not located in a port.", "negation_binary", "not located Tug Port"), (11, "The between relation holds among a port, a ferry, and a tug.", "nary", "between [ Port , Ferry , Tug ]"), (12, "A port, a ferry, and a tug do not stand in the between relation.", "negation_nary", "not between [ Port , Ferry , Tug ]"), (13, "The tows relation holds between a tug and a ferry.", "binary", None), (14, "The guides relation holds between a harbour pilot and a dragon.", "binary", None),
    (15, "The guides relation holds between a harbour pilot and a small ferry.", "binary", "guides HarbourPilot Ferry"), (16, "The fleet consists of ferries, tugs and cargo ships.", None, "Ferry subclass-of Fleet Tug subclass-of Fleet CargoShip subclass-of Fleet"), (17, "The fleet consists of ferries and dragons.", None, None), (18, "The fleet does not comprise ferries and tugs.", None, None), (19, "Rain fell.", None, None), (20, None, None, None),
]
ROUTE_RELATIONS = [(r,) for r in ["guides", "agent", "destination", "located", "between"]]
#: statement_id, child, parent, path, line
MEMORY = [("m1", "CargoShip", "Vessel", "a", 3), ("m2", "HarbourPilot", "Person", "a", 1), ("m3", "ShipPilotSchool", "School", "a", 2), ("m4", "ProcessOfShip", "CargoProcess", "b", 1), ("m5", "Loading", "CargoProcess", "a", 9)]
RECALL_SOURCES = [("s1", "The cargo ship meets the pilot."), ("s2", "A process of information."), ("s3", "")]
#: id, statement_id, rank
RECALLED = [("s1", "m1", 1), ("s1", "m3", 2)]

#: id, text of prompts for the candidate language, over KNOWN and PROMPT_RELATIONS
PROMPTS = [("p1", "A tug is a vessel."), ("p2", "There is a port."), ("p3", "The guides relation holds between a pilot and a tug."), ("p4", "No pilot is a tug."), ("p5", "It sails. They wait."), ("p6", "Every tug guides a pilot.")]
PROMPT_RELATIONS = [("guides",), ("located",)]
#: prompt, statement, whether the prompt admits it
ADMITTED = [
    ("p1", "?x is-a Tug", True), ("p1", "?x is-a Vessel.", True), ("p1", "?x is-a Port", False), ("p1", "Tug subclass-of Vessel", False), ("p1", "guides Tug Vessel", False), ("p2", "some ?x is-a Port", True), ("p2", "some ?y is-a Port", False), ("p3", "guides Pilot Tug", True), ("p3", "guides ?b Tug", True),
    ("p3", "guides ?d Tug", False), ("p3", "located Pilot Tug", False), ("p3", "not guides Pilot Tug", False), ("p4", "not ?x is-a Tug", True), ("p4", "?x is-a Pilot", True), ("p5", "?x is-a Tug", False), ("p6", "every ?x is-a Tug implies guides ?x Pilot", True), ("p6", "if guides ?x Pilot then ?x is-a Tug", True), ("p6", None, False),
]
#: the whole language of p1, p2 and p4
LANGUAGE = [("p1", "?x is-a Tug"), ("p1", "?x is-a Vessel"), ("p2", "?x is-a Port"), ("p2", "some ?x is-a Port"), ("p4", "?x is-a Pilot"), ("p4", "?x is-a Tug"), ("p4", "not ?x is-a Pilot"), ("p4", "not ?x is-a Tug")]
#: id, text, child, parents, offered statements
CHILDREN = [("c1", "A dredger is a vessel.", "Dredger", "Vessel,Tug,Dredger", "Dredger subclass-of Tug|Dredger subclass-of Vessel"), ("c2", "Dredgers clear mud.", "Dredger", "Vessel", "")]
BACKGROUND = [("Tug", "Vessel"), ("CargoShip", "Vessel"), ("Pilot", "Procedure"), ("Fleet", "MilitaryProcess")]
#: id, text, implied statement
IMPLIED = [("i1", "A tug is a small boat.", "Tug subclass-of Vessel"), ("i2", "A pilot is a guide.", None), ("i3", "A tug is not a barge.", None), ("i4", "Tugs sail.", None), ("i5", "A port is a place.", None), ("i6", "Every tug is a boat.", None), ("i7", "The cargo ship was the largest.", "CargoShip subclass-of Vessel")]
#: id, cnl, text, licensed
LICENSED = [("l1", "Tug subclass-of Vessel", "A tug is a boat.", True), ("l2", "Tug subclass-of Vessel", "Tugs tow.", False), ("l3", "Vessel subclass-of Tug", "A tug is a vessel.", False), ("l4", "Pilot subclass-of Procedure", "A pilot is a guide.", False), ("l5", "Tug subclass-of Vessel", "A barge is a boat.", False)]
#: id, passage, alias, cue, symbol, parents, the one parent's statement
STATED = [
    ("s1", "Dredging is the process of clearing mud.", "Dredging", "is the", "DredgingProcess", "Process,Vessel", "DredgingProcess subclass-of Process"), ("s2", "Dredging is the process of clearing mud.", "Dredging", "is the", "DredgingProcess", "Vessel,Tug", None),
    ("s3", "A coaster is a vessel.", "coaster", "is a", "Coaster", "Vessel,Tug", "Coaster subclass-of Vessel"),
]
#: id, cnl, log-likelihood, tokens
SCORED = [("b1", "?x is-a Tug", -4.0, 4), ("b1", "?x is-a Vessel", -5.0, 8), ("b1", "?x is-a Port", -9.0, 4), ("b2", "some ?x is-a Port", -1.0, 1), ("b2", "another", -1.0, 1), ("b3", "empty", -1.0, 0)]
#: id, seq, parent, with the sentence, with an empty one
PARENT_SCORES = [("a1", 1, "Process", -2.0, -1.0), ("a1", 2, "IntelligenceProduct", -3.0, -4.0), ("a2", 1, "Process", -2.0, -2.0), ("a2", 2, "IntelligenceProduct", -2.0, -2.0)]
#: id, logits of two or three steps, confidence: softmax of equal logits is one half, of a lone one 1
LOGITS = [(1, [[0.0, 0.0], [3.0]], 0.75), (2, [[1.0, 1.0]], 0.5), (3, [], None)]
#: id, pattern, subject, predicate, object, quantifier, negated, cnl and kif
CLAIMS = [
    (1, "instance", "harbour tug", None, "ocean vessel", None, False, "Tug subclass-of Vessel", "(subclass Tug Vessel)"), (2, "instance", "a tug", None, "", None, True, "not ?x is-a Tug", "(not (instance ?x Tug))"), (3, "existential", "port", None, None, None, False, "some ?x is-a Port", "(exists (?x) (instance ?x Port))"),
    (4, "relation", "pilot", "shows the way", "tug", None, False, "guides Pilot Tug", "(guides Pilot Tug)"), (5, "relation", "pilot", "guides", "tug", "universal", True, "every ?x is-a Pilot implies guides ?x Tug", "(forall (?x) (=> (instance ?x Pilot) (not (guides ?x Tug))))"), (6, "relation", "the sea", "guides", "tug", None, True, "not guides ?x Tug", "(not (guides ?x Tug))"),
    (7, "relation", "pilot", "eats", "tug", None, False, None, None), (8, "conditional", "harbour pilot", "is located near", "moon", None, False, "every ?x is-a HarbourPilot implies located ?x ?y", "(forall (?x) (=> (instance ?x HarbourPilot) (located ?x ?y)))"), (9, "subclass", "tug", None, "moon", None, False, None, None),
    (10, "existential", "deep water port", None, None, None, False, "some ?x is-a Port", "(exists (?x) (instance ?x Port))"), (11, "odd", "tug", None, "vessel", None, False, None, None), (12, "instance", "sea bus", None, None, None, False, "?x is-a Ferry", "(instance ?x Ferry)"),
]
#: id, answer, claims in it
RESPONSES = [(1, 'Here: [{"pattern":"instance","subject":"tug"}] done', 1), (2, '{"pattern":"subclass","subject":"tug","object":"vessel"}', 1), (3, "no claims", None), (4, "[]", 0), (5, None, None)]
PASSAGES = [("r1", "d", "1-1", "A tug is a vessel that tows."), ("r2", "d", "1-1", "Pilots guide tugs."), ("r3", "d", "1-2", "A fleet is large.")]
PAGES = [("1-1", "A tug is a  vessel that tows. Pilots guide tugs."), ("1-2", "Nothing here.")]
#: record_id, doc_id, page, source_span, status, reviewer_type, reviewed_by, decision, abstention_reason, coverage, claim_text, cnl, kif, compiled, terms, broken rules
PACKET = [
    ("r1", "d", "1-1", "A tug is a vessel", "reviewed", "ai", "x", "positive", None, "full", "A tug is a vessel", "Tug subclass-of Vessel", "(subclass Tug Vessel)", "(subclass Tug Vessel)", "Vessel,Tug", "preloaded"),
    ("r2", "d", "1-1", "Pilots guide", "reviewed", "human", "y", "abstain", "deixis", None, None, None, None, None, "", ""), ("r3", "d", "1-1", "A fleet is large", "draft", "ai", "x", "positive", None, "some", "", "Fleet subclass-of Vessel", "(a)", "(subclass Fleet Vessel)", "Fleet", "compiled,coverage,incomplete,reviewer,source reference,span not on page,terms"),
    ("r4", "d", "1-1", "A tug", "reviewed", "bot", "x", "abstain", "bored", None, "said", None, None, None, "", "abstention asserts,abstention reason,reviewer,source reference,span not in excerpt,unknown id"), ("r5", "d", "9-9", "", "reviewed", "ai", "x", "maybe", None, None, None, None, None, None, "", "decision,source reference,span not in excerpt,span not on page,unknown id"),
]
#: alias, cue, symbol, declaration, broken rules
REGISTRY = [("dredger", "is a", "Dredger", "(instance Dredger Class)", ""), ("Tug  boat", "is a", "Tug", "(instance Tug Class)", "known class,repeated alias"), ("tug boat", "is a", "TugBoat", "(instance Tugboat Class)", "declaration,repeated alias"), ("barge", "", "barge", "(instance barge Class)", "blank,symbol form")]
#: Narrower classes for typed pairs, and how many rows each generator then makes
NARROWER = [("Vessel", "Ferry"), ("Vessel", "OreShip")]
TYPED_SIGNATURE = [("between", 1, "Vessel"), ("between", 2, "Port"), ("guides", 1, "Pilot"), ("guides", 2, "Vessel"), ("located", 1, "Vessel"), ("located", 2, "Vessel")]
VARIANTS = [("Process", "is the", "is the process of moving goods."), ("IntelligenceProduct", "is an", "is an intelligence product for planners.")]
#: lines of a benchmark file, and their faults
BENCH = [
    ('{"record_id": "a", "doc_id": "d", "nl": "A tug is a vessel.", "formalizable": true, "cnl": "Tug subclass-of Vessel", "kif": "(subclass Tug Vessel)", "status": "reviewed", "split": "eval"}', ""), ("not json", "not a record"),
    ('{"record_id": "a", "doc_id": "d", "nl": "x", "formalizable": false, "status": "draft", "split": "seed"}', "repeated record_id"), ('{"record_id": "b", "doc_id": " ", "nl": "x", "formalizable": false, "kif": "(a)", "status": "odd", "split": "test"}', "missing doc_id,status,split,abstention asserts"),
    ('{"record_id": "c", "doc_id": "d", "nl": "x", "status": "accepted", "split": "train"}', "formalizable missing"), ("  ", None), ('{"record_id": "e", "doc_id": "d", "nl": "x", "formalizable": true, "status": "accepted", "split": "train"}', "positive without form"),
]
