"""Closed vocabularies of dependency treebanks."""

# Tags, labels, registers and sources that records may carry.
UPOS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
BASE_LABELS = (
    "acl advcl advmod amod appos aux case cc ccomp clf compound conj cop csubj dep det discourse dislocated expl fixed flat "
    "goeswith iobj list mark nmod nsubj nummod obj obl orphan parataxis punct reparandum root vocative xcomp"
).split()
# The subtypes that are known of each base label.
SUBTYPES = {
    "acl": ["relcl", "subj", "tmod", "tonp"],
    "advcl": ["objective"],
    "advmod": ["adj", "dir", "neg"],
    "appos": ["nmod"],
    "aux": ["pass"],
    "clf": ["det"],
    "compound": ["adj", "amod", "apr", "atov", "dir", "pron", "prt", "redup", "svc", "verbnoun", "vmod", "z"],
    "csubj": ["asubj", "pass", "vsubj"],
    "det": ["pmod"],
    "flat": ["date", "foreign", "name", "number", "redup", "time"],
    "mark": ["pcomp"],
    "nmod": ["poss"],
    "nsubj": ["nn", "pass", "xsubj"],
    "nummod": ["det"],
    "obl": ["about", "adj", "adv", "agent", "comp", "iobj", "tmod", "with"],
    "xcomp": ["adj", "dir", "vcomp"],
}
REGISTERS = "formal informal teencode non_diacritic mixed".split()
SOURCES = ["stub", "real"]
# Forms whose use is counted, and the marker of possession.
DIRECTION_FORMS = ["ra", "vào", "lên", "xuống", "về"]
FOCUS_FORMS = ["cái", "con", "chiếc", "cuốn", "và", "hoặc", "hay", "đi", "ra", "vào", "lên", "xuống", "về", "của", "à", "nhé", "đấy", "nha", "đó"]
MARKER = "của"

LABEL_BASE = {base: base for base in BASE_LABELS} | {f"{base}:{sub}": base for base, subs in SUBTYPES.items() for sub in subs}
