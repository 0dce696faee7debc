"""Names, word lists and patterns of the corpus. They must stay as they are for equal results."""

# Outlet names by key (letters only, lower case, no leading "the").
OUTLETS = {
    "globeandmail": "The Globe and Mail",
    "ottawacitizen": "The Ottawa Citizen",
    "ottawasun": "The Ottawa Sun",
    "torontostar": "Toronto Star",
    "torontosun": "The Toronto Sun",
    "windsorstar": "The Windsor Star",
    "hamiltonspectator": "The Hamilton Spectator",
    "spectator": "The Hamilton Spectator",
    "nationalpost": "National Post",
    "saultstar": "Sault Star",
    "sudburystar": "Sudbury Star",
    "kingstonwhigstandard": "Kingston Whig-Standard",
    "standard": "The Standard",
}

# Outlet families, first needle that occurs wins.
FAMILIES = (
    ("globeandmail", "globe"),
    ("nationalpost", "natpost"),
    ("torontostar", "star"),
    ("spectator", "hamspec"),
    ("torontosun", "torsun"),
    ("ottawasun", "ottsun"),
    ("ottawacitizen", "ottcitizen"),
    ("saultstar", "saultstar"),
    ("windsorstar", "windsorstar"),
    ("londonfreepress", "lfp"),
    ("sudburystar", "sudburystar"),
    ("whig", "kingstonwhig"),
    ("standard", "stcstandard"),
    ("record", "record"),
)

# Short outlet names of the extraction tables.
SHORT_NAMES = {
    "the globe and mail": "Globe and Mail",
    "toronto star": "Toronto Star",
    "the toronto star": "Toronto Star",
    "the toronto sun": "Toronto Sun",
    "national post": "National Post",
    "the hamilton spectator": "Hamilton Spectator",
    "the ottawa citizen": "Ottawa Citizen",
    "the ottawa sun": "Ottawa Sun",
}

# Corrupted dates and what they stand for.
DATE_FIXES = {"0002-06-03": "2024-06-03", "0020-02-24": "2025-02-24", "0020-05-11": "2024-05-11", "0202-01-04": "2024-01-04"}
DATE_RANGE = ("2023-06-01", "2025-12-31")

# Texts that are as good as none.
UNUSABLE = ("", "Not available.")

# Title patterns.
PAGE_JUNK = r"^\s*\w+ \d{1,2}, \d{4} \(Page "
LETTER_TITLE = r"(?i)(^\s*letters?\b.*(editor|:)|letters to the editor)"

# Dictionaries (a trailing * matches any ending).
PROVINCIAL = {"on": ["crombie", "stiles", "schreiner", "ontario pc*", "ontario liberal*", "ontario ndp", "ontario green*", "ontario election", "ontario premier"]}
CONTEXT = {"ctx": ["doug", "premier", "queen*s park", "ontario"]}
FEDERAL = {"fed": ["carney", "trudeau", "poilievre", "freeland", "gould", "baylis", "dhalla", "jagmeet", "singh", "blanchet", "prime minister"]}
GATED = {"ford": ["ford"]}
PARTIES = {
    "liberals": ["liberals"],
    "ontario_liberals": ["ontario liberals", "ontario liberal"],
    "conservatives": ["conservative", "conservatives"],
    "progressive_conservatives": ["progressive conservatives", "pcs", "progressive conservative"],
    "ontario_conservatives": ["ontario conservatives"],
}
LEADERS = {"ford": ["doug ford", "ford"], "crombie": ["crombie"], "stiles": ["stiles"], "schreiner": ["schreiner"]}
ISSUES = {
    "housing": ["housing", "rent", "rents", "renter*", "landlord*", "tenant*", "mortgage*", "homeless*", "condo*", "housing affordability", "home prices", "homebuilding", "homebuilder*", "housing starts"],
    "tariffs_trade": ["tariff*", "free trade", "trade war*", "protectionis*", "interprovincial trade", "trade deal*", "trade agreement*", "countervail*", "buy canadian", "buy ontario"],
    "taxes": ["tax", "taxes", "taxation", "taxpayer*", "carbon tax", "income tax", "property tax*", "hst", "tax cut*", "tax credit*", "tax break*"],
    "health_care": ["health care", "healthcare", "hospital*", "family doctor*", "family physician*", "primary care", "emergency room*", "nurse*", "nursing", "physician*", "wait times", "long-term care", "ohip", "surger*"],
    "education": ["education", "school*", "teacher*", "classroom*", "curriculum", "kindergarten", "school board*", "class sizes"],
    "post_secondary": ["post-secondary", "postsecondary", "universit*", "college", "colleges", "tuition", "college strike", "college faculty", "opseu", "campus*", "international student*"],
    "immigration": ["immigration", "immigrant*", "migrant*", "refugee*", "asylum", "newcomer*", "deportation*", "visa*"],
    "crime": ["crime", "crimes", "criminal*", "police", "policing", "theft*", "auto theft", "shooting*", "homicide*", "murder*", "gun violence", "bail", "carjacking*", "gang*", "violent crime"],
}
PHRASES = ("housing affordability", "health care", "primary care", "post secondary", "buy canadian", "buy american")

# Seed words of the guided topics.
SEEDS = {
    "housing": ["housing", "rent", "rents", "renter", "landlord", "affordability", "homebuilding", "homebuilder", "apartment", "apartments", "encampment", "house", "permit", "zoning", "tenant", "mortgage", "homeless", "condo", "nimby", "housing affordability"],
    "tariffs_trade": ["tariff", "tariffs", "trade", "protectionist", "countervailing", "buy", "countervail", "buy canadian", "buy american"],
    "taxes": ["tax", "taxes", "taxation", "taxpayer", "hst"],
    "health_care": ["health care", "healthcare", "hospital", "doctor", "physician", "primary care", "nurse", "nursing", "hospitals", "dr", "ohip", "surgery"],
    "education": ["education", "school", "teacher", "classroom", "teachers", "curriculum", "kindergarten", "schools", "students"],
    "post_secondary": ["post secondary", "post-secondary", "postsecondary", "university", "college", "colleges", "tuition", "professor", "opseu", "campus", "universities", "osap", "student"],
    "crime": ["crime", "crimes", "criminal", "police", "policing", "theft", "shooting", "homicide", "murder", "violence", "bail", "carjacking", "gang", "violent", "prison"],
}

# Words without content, and those that this corpus adds.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing would should could ought a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very will"
).split() + ["said", "mr", "ms", "mrs", "also", "get"]

# Levels of the approval series and the certainty fields of an extracted row.
LEADER_LEVELS = ("Ford", "Crombie", "Stiles", "Fraser (interim Lib)")
CERTAINTIES = ("topic_certainty", "actor_certainty", "sentiment_certainty", "ascribing_certainty", "public_certainty")
CERTAINTY_LIMIT = 87
REVIEW_NOTE = " [crosscheck revised sentiment_certainty]"
