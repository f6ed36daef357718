"""Fixed values of the turn detectors. They must equal the values the logged
data was produced with; order matters where the first match wins."""

SESSION_END_PHRASES = [
    "thanks", "thank you", "that's all", "that's it", "i'm done", "im done",
    "goodbye", "bye", "see you", "see ya", "all set", "got it", "perfect",
    "great thanks", "no more questions", "nothing else", "that's everything",
    "i'm good", "im good", "i'm all good", "that'll do", "no thanks",
]
SHORT_ENDINGS = ["ok", "okay", "k", "sure", "yep", "nope", "nah", "alright", "cool", "noted"]
WRAP_UP_PHRASES = [
    "anything else", "let me know", "here if you need", "feel free to ask",
    "happy to help", "have a great day", "come back", "is there anything",
    "can i help", "hope that helps", "if you need anything",
]
SESSION_END_MAX_WORDS = 6

WELLBEING_PHRASES = [
    "feeling low", "feeling sad", "feeling depressed", "feeling lonely",
    "i'm sad", "im sad", "i'm depressed", "im depressed",
    "i'm lonely", "im lonely", "i'm not okay", "im not okay",
    "not doing well", "talk to me", "need someone to talk",
    "having a hard time", "going through a tough time",
    "stressed", "anxious", "overwhelmed", "hopeless",
    "want to hurt", "hurting myself", "end my life", "suicide",
    "nobody cares", "no one cares", "feel worthless",
]

UNCERTAINTY_PHRASES = [
    "i don't have", "i don't know", "i'm not sure", "i cannot find",
    "not available in", "no information", "outside my knowledge",
    "can't help with that", "unable to find", "not in our catalog",
]
SCOPE_MARKER = "i'm here to help with home improvement"

VULGAR_PATTERNS = [
    (r"\b(porn|pornography|xxx|onlyfans)\b", "pornography"),
    (r"\b(naked|nude|nudity|nudes)\b", "nudity"),
    (r"\b(sex|sexual|sexually|intercourse|foreplay)\b", "sexual"),
    (r"\b(masturbat\w+|orgasm|ejaculat\w+)\b", "explicit_sexual"),
    (r"\b(erotic|erotica|fetish|bdsm|kink\w*)\b", "explicit_sexual"),
    (r"\b(fuck|fucking|fucked|fucker|fucks)\b", "profanity"),
    (r"\bc[u\*]nt\b", "profanity"),
    (r"\bcock\b(?!\s*(pit|roach|tail|erel|atoo))", "sexual"),
    (r"\bdick\b(?!\s*(ens|inson|son))", "sexual"),
    (r"\bpussy\b(?!\s*(cat|willow|foot))", "sexual"),
    (r"\bash+ole\b", "profanity"),
    (r"\bwhor[e\x08]", "profanity"),
    (r"\bslut\b", "profanity"),
    (r"\b(have sex|sleep with|hook up) with you\b", "sexual_solicitation"),
    (r"\bshow me your (body|breasts?|genitals?)\b", "sexual_solicitation"),
    (r"\bsend (me )?(nudes?|naked|sexy) (pics?|photos?|pictures?)", "sexual_solicitation"),
]

INJECTION_PATTERNS = [
    (r"ignore\s+(all\s+)?previous\s+instructions?", "ignore_instructions"),
    (r"(disregard|forget)\s+(your\s+)?(previous\s+)?instructions?", "disregard_instructions"),
    (r"you\s+are\s+now\s+(a|an|the)\s+", "persona_override"),
    (r"act\s+as\s+(a|an|the)\s+(?!store|sales|product|shop)", "act_as"),
    (r"pretend\s+(you\s+are|to\s+be)\s+", "pretend_as"),
    (r"\b(jailbreak|dan\s+mode|do\s+anything\s+now)\b", "jailbreak"),
    (r"reveal\s+(your\s+)?(system\s+)?(prompt|instructions?)", "extract_prompt"),
    (r"what\s+(are|were)\s+your\s+(system\s+)?instructions?", "extract_prompt"),
    (r"override\s+(your\s+)?(safety|guidelines?|instructions?)", "safety_override"),
]
INJECTION_MAX_CHARS = 4000
INJECTION_TOO_LONG = "message_too_long"

FRUSTRATION_PATTERNS = [
    (r"\b(never mind|nevermind|forget it|forget that)\b", "giving_up"),
    (r"\bnot (what i|what I) (needed|wanted|asked|meant|was looking for)\b", "mismatch"),
    (r"\bthat'?s? (not (right|helpful|correct|what i|it)|wrong)\b", "rejection"),
    (r"\b(useless|not helpful|unhelpful|doesn'?t help)\b", "unhelpful"),
    (r"\bjust (search|look|find) (it |myself|on my own)", "abandoning"),
    (r"\bno[,.]?\s+(not that|that'?s? not)\b", "rejection"),
    (r"\b(wrong product|wrong item|not the right)\b", "mismatch"),
]
REPHRASE_OVERLAP = 0.6
REPHRASE_MIN_WORDS = 3
REPHRASE_REASON = "repeated_rephrase"
UNANSWERED_REASON = "after_unanswered"

CATEGORY_KEYWORDS = {
    "Power Tools": ["drill", "saw", "grinder", "sander", "router", "jigsaw", "circular saw", "impact driver",
                    "nail gun", "heat gun", "power tool"],
    "Hand Tools": ["hammer", "screwdriver", "wrench", "pliers", "chisel", "hand tool", "tape measure", "level",
                   "utility knife"],
    "Outdoor & Garden": ["lawn", "mower", "garden", "grass", "trimmer", "edger", "fertilizer", "soil", "mulch",
                         "seed", "weed", "sprinkler", "hose", "rake", "shovel", "chainsaw", "leaf blower",
                         "pressure washer", "snow blower", "generator", "outdoor power"],
    "Plumbing": ["pipe", "faucet", "toilet", "sink", "drain", "valve", "fitting", "plumbing", "water heater",
                 "garbage disposal"],
    "Electrical": ["wire", "cable", "outlet", "switch", "breaker", "circuit", "electrical", "conduit", "panel",
                   "speaker wire", "in-wall wire", "audio cable"],
    "Flooring": ["floor", "tile", "hardwood", "laminate", "vinyl", "carpet", "grout", "underlayment"],
    "Paint & Supplies": ["paint", "primer", "stain", "brush", "roller", "spray", "coating", "varnish", "caulk",
                         "sealant"],
    "Safety & Security": ["safety", "glove", "helmet", "goggle", "respirator", "harness", "protective", "lock",
                          "deadbolt", "camera", "alarm"],
    "Storage & Organization": ["shelf", "cabinet", "rack", "storage", "organizer", "bin", "drawer", "pegboard"],
    "Heating & Cooling": ["hvac", "air conditioner", "heater", "furnace", "duct", "vent", "thermostat", "filter",
                          "fan", "dehumidifier"],
    "Building Materials": ["insulation", "soundproof", "sound dampening", "acoustic", "drywall", "home theatre",
                           "home theater", "theatre room", "theater room", "sound barrier", "noise reduction",
                           "framing", "lumber", "plywood", "concrete", "cement", "batt", "r-value"],
}

PRICE_PATTERNS = [
    r"under\s*\$?(\d+(?:\.\d+)?)",
    r"below\s*\$?(\d+(?:\.\d+)?)",
    r"less\s+than\s*\$?(\d+(?:\.\d+)?)",
    r"cheaper\s+than\s*\$?(\d+(?:\.\d+)?)",
    r"up\s+to\s*\$?(\d+(?:\.\d+)?)",
    r"within\s*\$?(\d+(?:\.\d+)?)",
    r"max(?:imum)?\s*\$?(\d+(?:\.\d+)?)",
    r"budget\s*(?:of\s*|around\s*|~\s*)?\$?(\d+(?:\.\d+)?)",
    r"\$?(\d+(?:\.\d+)?)\s*budget",
    r"around\s*\$(\d+(?:\.\d+)?)",
]

KEYWORD_STOP_WORDS = [
    "what", "which", "that", "this", "with", "have", "from", "your", "best", "good",
    "need", "want", "some", "for", "can", "how", "does", "show", "find", "give",
    "tell", "about", "under", "over", "more", "less", "cheap", "cheaper", "those", "other",
]
KEYWORD_MIN_CHARS = 4

INTENT_LABELS = ["product_lookup", "project_advice", "compatibility", "pricing_availability", "troubleshooting",
                 "general_chat"]
INTENT_UNKNOWN = "unknown"
INTENT_TARGET_CHARS = 100
GENERAL_TARGET = "general"

# Prices in USD per million tokens and the size of the context window.
PRICES = {"in": 0.30, "out": 2.50, "intent_in": 0.30, "intent_out": 2.50}
CONTEXT_TOKENS = 1_000_000
CHARS_PER_TOKEN = 4
PROMPT_TOKENS = 512

# Our own: for the patterns that are costly to search for, texts one of which
# is part of every match. A row without any of them skips the pattern.
NEEDLES = {
    r"\b(porn|pornography|xxx|onlyfans)\b": ["porn", "xxx", "onlyfans"],
    r"\b(naked|nude|nudity|nudes)\b": ["naked", "nud"],
    r"\b(sex|sexual|sexually|intercourse|foreplay)\b": ["sex", "intercourse", "foreplay"],
    r"\b(masturbat\w+|orgasm|ejaculat\w+)\b": ["masturbat", "orgasm", "ejaculat"],
    r"\b(erotic|erotica|fetish|bdsm|kink\w*)\b": ["erotic", "fetish", "bdsm", "kink"],
    r"\b(fuck|fucking|fucked|fucker|fucks)\b": ["fuck"],
    r"\bc[u\*]nt\b": ["cunt", "c*nt"],
    r"\bcock\b(?!\s*(pit|roach|tail|erel|atoo))": ["cock"],
    r"\bdick\b(?!\s*(ens|inson|son))": ["dick"],
    r"\bpussy\b(?!\s*(cat|willow|foot))": ["pussy"],
    r"\bash+ole\b": ["ash"],
    r"\bwhor[e\x08]": ["whor"],
    r"\bslut\b": ["slut"],
    r"\b(have sex|sleep with|hook up) with you\b": ["with you"],
    r"\bshow me your (body|breasts?|genitals?)\b": ["show me your"],
    r"\bsend (me )?(nudes?|naked|sexy) (pics?|photos?|pictures?)": ["send "],
    r"\b(never mind|nevermind|forget it|forget that)\b": ["never mind", "nevermind", "forget "],
    r"\bnot (what i|what I) (needed|wanted|asked|meant|was looking for)\b": ["not what i "],
    r"\bthat'?s? (not (right|helpful|correct|what i|it)|wrong)\b": ["that"],
    r"\b(useless|not helpful|unhelpful|doesn'?t help)\b": ["useless", "help"],
    r"\bjust (search|look|find) (it |myself|on my own)": ["just "],
    r"\bno[,.]?\s+(not that|that'?s? not)\b": ["that"],
    r"\b(wrong product|wrong item|not the right)\b": ["wrong ", "not the right"],
}
