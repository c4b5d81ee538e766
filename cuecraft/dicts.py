"""Small dictionaries that operators take as parameters; every one can be replaced by a list or a table's rows."""

# Interjections that captions spell as words.
INTERJECTIONS = "ah eh hah heh hey hi hm hmm huh mm mmh nah no nope oh omg uh um whoa wow yeah yep yes".split()

# Our own defaults, by what a word does in speech: it gains time, softens, points at nothing, or hands over.
_GAINING = "um umm uh uhh er erm hmm mhm"
_SOFTENING = "apparently basically essentially honestly kinda literally obviously roughly somehow sorta supposedly totally"
_POINTING = "anything everything someone somebody stuff thing things thingy whatever whatnot"
_HANDING = "alright anyhow anyways okay right so well yeah yep"
FILLERS = f"{_GAINING} {_SOFTENING} {_POINTING} {_HANDING}".split()
CONTRACTIONS = {"can't": "can not", "don't": "do not", "doesn't": "does not", "didn't": "did not", "it's": "it is", "i'm": "i am", "isn't": "is not", "that's": "that is", "they're": "they are", "we're": "we are", "won't": "will not", "you're": "you are"}
BLOCKED = "the and for that this with was are you they have from what when your not but all can had her his how its one our out she their them then there these were will would about into more some than been who which also because could".split()
PROFANE = "damn hell crap".split()
URL_FRAGMENTS = "http https www com org net html watch".split()
#: Words that open a sentence or are never the head of an entity.
STARTERS = "after also before finally first here however maybe meanwhile next now once our still there they today we when while yes you".split()
FIRST_NAMES = "alex anna ben david emma james john lisa maria mike paul sarah tom".split()
NICHES = {  # niche -> (keywords, strong ones); keywords of two words are joined by an underscore
    "finance": ("money invest stock budget debt index_fund", "invest stock index_fund"),
    "gaming": ("game level boss console speedrun side_quest", "console speedrun side_quest"),
    "cooking": ("recipe oven dough sauce flour olive_oil", "recipe dough olive_oil"),
}
NICHE_TAGS = {"finance": ["#money", "#finance"], "gaming": ["#gaming", "#gamer"], "cooking": ["#cooking", "#food"], "general": ["#viral", "#trending", "#foryou"]}
CORE_PATTERNS = [  # pattern, framework, template
    ("p_truth", "Reveal", "The Truth About {kw} Nobody Shares"), ("p_why", "Question", "Why {kw} Changes Everything Here"), ("p_how", "Explainer", "How {kw} Really Works In Practice"),
    ("p_never", "Warning", "Never Ignore {kw} Again This Year"), ("p_num", "List", "{n} Lessons From {kw} Worth Keeping"), ("p_secret", "Reveal", "The Secret Behind {kw} Finally Explained"),
    ("p_versus", "Comparison", "{kw} Against {kw2} Put To The Test"),
]
BONUS_PATTERNS = {  # niche -> patterns that come first
    "finance": [("p_cost", "Breakdown", "What {kw} Costs You Over Time"), ("p_rule", "Explainer", "The {kw} Rule Worth Your Money")],
    "gaming": [("p_run", "Showcase", "This {kw} Run Broke Every Record")],
}
SEO_PATTERNS = [
    ("s_plain", "Explainer", "{kw} Explained In Plain Words"), ("s_facts", "List", "{n} Facts About {kw} Worth Sharing"), ("s_days", "First Person", "My {n} Days With {kw} In Detail"),
    ("s_error", "Loss", "The Costly Error Behind {kw}"), ("s_proof", "Proof", "Hard Evidence That {kw} Matters"), ("s_both", "Comparison", "Where {kw} Meets {kw2} For Real"),
]
FALLBACK_PATTERNS = [
    ("f_detail", "Explainer", "This {cap} Detail Goes Unseen"), ("f_part", "Story", "The Part Of {cap} Most Skip"), ("f_end", "Curiosity", "Stay For The {cap} Ending"), ("f_rule", "Value", "{cap} Rules Learned Too Late"),
]
COUNTS = [5, 7, 3, 10, 6]
TONES = {  # tone -> (frameworks that come first, whether titles end with a sign)
    "high_energy": ((), True), "professional": (("Explainer", "Breakdown", "Comparison", "Proof"), False), "playful": (("Showcase", "Question", "Story"), True),
}
SIGNS = {"finance": "\U0001f4b0", "gaming": "\U0001f3ae", "cooking": "\U0001f373", "general": "\U0001f4a1"}
# Headline style as style guides have it: articles, coordinating conjunctions and prepositions of up to three letters.
ARTICLES, COORDINATING, PREPOSITIONS = "a an the", "and but for nor or so yet", "as at by in of off on per to up via"
SMALL_WORDS = f"{ARTICLES} {COORDINATING} {PREPOSITIONS}".split()
HOOK_WEIGHTS = [(r"\bwhy\b", 1.0), (r"\bhow\b", 0.8), (r"\bsecret\b", 1.5), (r"\btruth\b", 1.5), (r"\bnever\b", 1.2), (r"\bfinally\b", 0.6)]
TRIGGERS = "always best mistake never secret truth worst".split()
GREETING = r"(?i)^\s*(?:good (?:morning|evening)|greetings|hello|hey|hi|welcome)\b[\s,]+(?:again|all|back|everybody|everyone|folks|friends|people|there|to)\b"
VISUAL = "money car city ocean mountain fire".split()
EMOJI = {"fire": "\U0001f525", "money": "\U0001f4b0", "city": "\U0001f3d9", "ocean": "\U0001f30a"}
KEYWORD_RULES = [("number", r"^\d"), ("shout", r"^[A-Z]{3,}$"), ("question", r"(?i)^(why|how|what)$"), ("long", r"^.{9,}$")]
FRAMES = [("f_how", r"(?i)\bhow\b"), ("f_why", r"(?i)\bwhy\b"), ("f_num", r"\d"), ("f_urgent", r"(?i)urgent"), ("f_high", r"(?i)high")]
#: Frames of ideas: title and opening sentence; the defaults fill up what a channel's titles do not show.
IDEAS = {
    "f_how": ("How To Read {subject} In {minutes} Minutes", "Reading {subject} takes a few good steps and no more."), "f_why": ("Why {subject} Is Misread So Often", "Most people read {subject} the wrong way around."),
    "f_num": ("{count} Findings On {subject} That Last", "These findings on {subject} came one by one."), "f_urgent": ("{subject} Is Changing Right Now", "Something about {subject} is moving as we speak."),
    "f_high": ("Living With {subject} For {days} Days", "I kept to {subject} for {days} days without a break."),
}
DEFAULT_FRAMES = ["f_how", "f_why", "f_num", "f_high"]
MINUTES, DAYS, SUFFIXES = [10, 15, 20, 30], [7, 14, 30], ["Part 2", "In Full", "And After"]
OPENERS = {"curiosity": "Look at this before I say a word about it.", "story": "This happened to me last year.", "claim": "Here is what few will tell you."}
BEATS = ["The same thing holds at every size.", "After that you see it everywhere you look.", "From there on the rest was only detail.", "It came back a second time and looked no different.", "What to watch for matters more than the answer."]
SCAFFOLD = "the a an and or of to in is are this that with your my what why how everyone makes about really".split()
#: Words and phrases that draw just now, with their weights; none until there is data.
TRENDS: dict[str, float] = {}
#: Templates that have been seen too often.
DEAD = [r"(?i)^you won't believe", r"(?i)\bgone wrong\b", r"(?i)^wait for it", r"(?i)\bmust (see|watch)\b"]
