"""Dictionaries made for the driver's tables, whose words are syllables; the library's own are in cuecraft.dicts."""

from cuecraft import dicts

NICHES = {"alpha": ("ther thon thre tion of_the", "ther thon"), "beta": ("rewh orre thatin onre der_die", "rewh orre der_die")}
NICHE_TAGS = {"alpha": ["#alpha", "#first"], "beta": ["#beta", "#second", "#third"], "general": ["#general"]}
BONUS_PATTERNS = {
    "alpha": [("a_case", "Breakdown", "The {kw} Case In Numbers"), ("a_rule", "Explainer", "One {kw} Rule For Everyone"), ("a_more", "Story", "More {kw} Than Ever Before")],
    "beta": [("b_run", "Showcase", "This {kw} Run Set Records")],
}
SIGNS = {"alpha": "A", "beta": "", "general": "G"}
PROFANE = ["the", "der"]
STRONG_TOPICS = ["ther", "thon"]
EMOJI = {"the": "T", "and": "A", **dicts.EMOJI}
CLEAN = {"fillers": dicts.FILLERS}
TRENDS = {"ther": 0.75, "changes everything": 0.5, "really works": -0.25, "rule": 0.6}
DEAD = [r"^The Truth About", *dicts.DEAD]
