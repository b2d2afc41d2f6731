r"""Patterns of what postings say.

They decide facts word for word, so they are kept whole and in their own order;
the logic that reads them is in stated.py and extract.py. All are matched
without regard to case, on text with plain quotes and dashes.
"""

# fmt: off
# Whether a sentence says that graduates may apply, or that only students may.
GRADUATES_ELIGIBLE = (
    r"\b(?:(?:recent|fresh)(?:ly)?[- ]graduat(?:es?|ed)|graduated\s+(?:with|in|within|less\s+than|no\s+more\s+than)|or\s+(?:have\s+|has\s+)?graduated"
    r"|recently\s+completed\s+(?:(?:a|an|your|their|the)\s+)?(?:[\w'-]+\s+){0,3}?(?:degrees?|studies|bachelor|master|ph\.?\s?d|doctorate|msc|bsc|mba|university)"
    r"|students?\s+(?:or|/)\s+(?:recent\s+)?graduates|final[- ]year\s+students?\s+(?:and|or|/|&)\s+(?:recent\s+)?graduates"
    r"|graduates\s+(?:or|/)\s+(?:(?:current|final[- ]year|penultimate[- ]year|university)\s+)?students?"
    r"|graduates\s+(?:are\s+)?(?:also\s+)?(?:welcome|eligible|(?:may|can)\s+(?:also\s+)?apply)|graduates\s+only)"
)
STUDENTS_ONLY = (
    r"\b(?:penultimate[- ]year|currently\s+(?:enrolled|pursuing|studying)|(?:1st|first)[- ]year\s+(?:of\s+(?:a|an|your)\s+)?(?:master'?s|msc|mba|ph\.?\s?d|postgraduate)"
    r"|returning\s+to\s+(?:university|(?:full[- ]time\s+)?stud(?:y|ies)|(?:full[- ]time\s+)?education)|current\s+(?:university\s+)?students\s+only)"
)
NEGATION = r"\b(?:not|no|never|cannot|ineligible|excluded|unable)\b|n't\b"
EXCLUDED_BEFORE = r"\b(?:already|other|fellow)\s+$"
OTHER_ROUTE = (
    r"\bor\s+(?:holding|hold|graduated)\b|\bor\s+(?:have\s+(?:completed|obtained|held|recently\s+completed)|completed|recently\s+completed)\b[^.!?;\n]{0,30}?"
    r"\b(?:degree|master|bachelor|studies|msc|bsc|mba|ph\.?\s?d)|\bdegree\s*\(\s*or\s+expected\b"
)

# Words that the quote of a fact must have, or must not.
BAR_WORDS = {
    "nationality": (
        r"\b(?:nationals?(?!\s+origin)|nationality|nationalities|citizens?|citizenship|passports?|emiratis?|saudis|uaen|family\s+book|emirati[sz]ed"
        r"|(?:saudi|emirati|omani|qatari|kuwaiti|bahraini|national)i?[sz]ation)\b"
    ),
    "clearance": r"\b(?:clearances?|cleared|vetting|vetted|bpss|nppv\d?|uksv|security\s+checks?|top\s+secret|ts/sci|polygraph|(?-i:SC|DV|eDV|EDV))\b",
}
EQUAL_OPPORTUNITY = r"\b(?:without\s+regard|regardless\s+of|irrespective\s+of|equal\s+opportunit|discriminat)"
REQUIRES = (
    r"\b(?:must|required?|requires|requirement|only|eligib\w*|need(?:s|ed)?|necessary|mandatory|essential|have\s+to|open\s+to|restricted|limited"
    r"|reserved|cannot|unable|not|no)\b|n't\b"
)
GRADUATION = (
    r"\b(?:graduat(?:ing|ion|ed|es?)\b(?!\s+(?:programme|program|scheme|analyst|trainee|role|position|hire|opportunit\w*|intake))|class\s+of|completion"
    r"|complet(?:e|ing)\s+(?:your|the|a|their)\s+(?:degree|studies|programme|program|course)|degree\s+(?:by|in|before|between|no\s+later))\b"
)
STUDENTS_SERVED = (
    r"\bstudents?\s+(?:success|services?|support|experience|union|body|life|loans?|finance|accommodation|recruitment|engagement|affairs|wellbeing|records?"
    r"|journey|outcomes|retention|satisfaction|data|information|systems?)\b"
)

# Counts of years. The count itself, the words around it, and what makes it no requirement.
_COUNT = r"(?<![\d.])(\d{1,2})(?:\.\d+)?\s*\+?(?:\s*(?:-|\u2013|\u2014|to)\s*\d{1,2}(?:\.\d+)?\s*\+?)?"
_YEARS = r"(?:years?|yrs?)(?:\s*\+)?(?:['\u2019]s?)?"
_LEAD = r"(?:(?:a\s+)?minimum(?:\s+of)?|min\.?|at\s+least|more\s+than|over|no\s+less\s+than|you\s+have)?\s*"
_BETWEEN = (
    r"(?!(?:you|your|will|and|with|gives?|giving|offer(?:s|ing)?|our|we|the|an?|to|in|on|at|for|that|which|is|are|gain|gaining|get|providing|provides?|"
    r"covers?|covering|including|max\.?|maximum|programmes?|programs?|schemes?|apprenticeships?|rotations?|contracts?|placements?|internships?|graduate|"
    r"training)\b)[\w/&,'\u2019\-]+\s+"
)
_TAIL = rf"\s+(?:of\s+)?(?:{_BETWEEN}){{0,3}}?(?:experience\b|exp\b|working\s+(?:in|with)\b|as\s+an?\b|in\s+(?:a|an|the)\s+(?:[\w\-]+\s+){{0,2}}?(?:role|position)\b)"
YEARS_STATED = (
    rf"\b{_LEAD}{_COUNT}\s*{_YEARS}{_TAIL}",
    rf"\bexperience\s*\(\s*{_COUNT}\s*{_YEARS}\s*\)",
    rf"\bexperience\s+of\s+(?:at\s+least\s+|a\s+minimum\s+of\s+|over\s+|more\s+than\s+)?{_COUNT}\s*{_YEARS}",
    rf"\b(?:seniority|experience(?:\s+level)?)\s*:\s*{_COUNT}\s*{_YEARS}",
    rf"\byears?\s+of\s+experience\s*:\s*{_COUNT}(?:\s*{_YEARS})?",
)
CLAUSE_START = r"[.;!?\n()]"
YEARS_CAP = (
    r"(?:\bup[\s-]*to|\bless\s+than|\bfewer\s+than|\bunder|\bno\s+more\s+than|\bnot\s+more\s+than|\bmaximum(?:\s+of)?|\bmax\.?|"
    r"\bwithin(?:\s+the)?(?:\s+last|\s+past)?|\bno|\bnot|\bfirst|\bnext|\blast|\bpast|\bprevious|\bfollowing|\bafter|"
    r"\bspen[dt]|\bserved?|\bgain(?:ing)?|\bgives?\s+you|\boffers?(?:\s+you)?|\bproviding|\bprovides?|\bcover(?:s|ing)?|\bat\s+most|\bacross|\bduring|"
    r"\bthroughout|\bover\s+the\s+course\s+of|\bruns?\s+for|\blasts?)\s*$"
)
YEARS_CAP_AFTER = (
    r"^\s*,?\s*or\s+(?:less|fewer)\b|^[^.;!?\n]{0,60}?\b(?:(?:are|is)\s+(?:not\s+eligible|ineligible)|will\s+not\s+be\s+considered|need\s+not\s+apply"
    r"|should\s+apply\s+(?:to|for)\s+(?:our\s+)?experienced)\b"
)
YEARS_CAP_TIGHT = r"\bmax\.?\s*$"
YEARS_SOFT = (
    r"\b(?:ideally|preferabl[ey]|preferred|desired|nice\s+to\s+have|good\s+to\s+have|bonus(?:\s+points)?|desirable|a\s+plus|advantage(?:ous)?|"
    r"even\s+better|we['\u2019]d\s+love|extra\s+points|stand\s+out|would\s+be\s+great|pluses)\b"
)
YEARS_SOFT_AFTER = (
    r"^[^.;!?\n]{0,60}?\b(?:preferred|preferable|a\s+plus|an?\s+advantage|advantageous|desirable|desired|nice\s+to\s+have|bonus|beneficial|helpful|"
    r"optional|welcome|valued|not\s+(?:required|essential|a\s+requirement|mandatory|necessary)|(?:is|are|would\s+be)\s+(?:an?\s+)?(?:asset|ideal|great|useful)|"
    r"would\s+(?:set\s+you\s+apart|help)|preferably(?!\s+(?:in|within|with|from|across|at|for|on)\b))\b"
)
YEARS_OTHERS = (
    r"\b(?:led\s+by|mentored\s+by|managed\s+by|headed\s+by|report(?:s|ing)?\s+to|who\s+ha(?:s|ve)|team\s+(?:of|members)|average|"
    r"our\s+(?:team|founders?|engineers|members|leadership|experts|consultants|people|staff))\b"
)
YEARS_ASKED = (
    r"\b(?:requires?|required|need(?:s|ed)?|looking\s+for|seeking|seeks?|wants?|must\s+have|should\s+have|and\s+have|will\s+have|have\s+at\s+least|"
    r"you(?:\s+will|['\u2019]ll)?\s+bring|with\s+at\s+least)\b"
)
YEARS_CANDIDATE = r"\b(?:someone|candidates?|applicants?|person|people|individuals?|you|those)\b[^.\n]{0,20}$"
YEARS_COMPANY = (
    r"^\s*(?!(?:candidates?|applicants?|you|we|our|they|the|must|should|ideal|all|successful|strong)\b)(?-i:(?:[A-Z][\w&.'-]*\s+){1,4}(?:has|have|brings?|boasts|offers?))\s*$"
)
YEARS_COMPANY_AFTER = r"^[^.;\n]{0,40}?,?\s+(?:we|our)\b|^[^.;\n]{0,40}?,\s+(?-i:(?:[A-Z][\w&.'-]*\s+){1,3}(?:is|has|was|offers?|provides?|delivers?|serves?))\b"
YEARS_WAIVED = r"^\s*[,;]?\s*or\b[^.\n]{0,60}?\b(?:master|msc|phd|doctorate|degree|equivalent)\b|^[^.;\n]{0,60}?\bor\s+equivalent\b"
YEARS_WAIVED_BEFORE = r"\b(?:degree|master'?s|msc|phd|doctorate|qualification|equivalent)\s*,?\s*or\s*$"
YEARS_CAREER = r"^[^.\n]{0,60}?\b(?:before\s+(?:being\s+)?promot\w*|progress(?:ion|ing)?\s+to|you\s+will\s+(?:progress|move|be\s+promoted)|leads?\s+to|promotion\s+to)\b"
_RANGE = r"(?<![\d.])(\d{1,2}(?:\.\d+)?)\s*(?:-|\u2013|\u2014|to)\s*(\d{1,2}(?:\.\d+)?)(?!\d)"
YEARS_RANGES = (
    rf"{_RANGE}\s*\+?\s*(?:years?|yrs?|yoe)\b",
    rf"\b(?:(?:(?:years?|yrs?)\s+of\s+(?:[\w-]+\s+)?)?experience(?:\s+(?:required|level|needed))?|yoe)\s*[:\-\u2013]?\s*(?:min(?:imum)?\.?\s*)?{_RANGE}",
)
YEARS_AGE_AFTER = r"^\s*(?:years?|yrs?)[\s-]+(?:old|of\s+age)\b"
YEARS_AGE_BEFORE = r"\bage(?:d|\s+limit)?\b[^\d]{0,10}$"
YEARS_FLOOR = r"\bno[t]?\s+(?:less|fewer)\s+than\s*$"

# Bars, and what makes the words of one none.
_NATION = r"(?:uae|emirati|saudi|ksa|qatari|kuwaiti|bahraini|omani|jordanian|gcc|british|uk|american|(?-i:US|U\.S\.))"
_NATIONS = rf"\b{_NATION}(?:\s*(?:,|/|&|\bor\b|\band\b)\s*{_NATION})*"
_NATIONAL = r"(?:nationals?|citizens?)\b"
_ADJECTIVE = (
    r"(?:motivated|ambitious|talented|high-potential|young|dynamic|driven|qualified|analytical|passionate|enthusiastic|bright|exceptional|outstanding)"
)
NATIONALITY_STATED = (
    rf"(?:{_NATIONS}\s+{_NATIONAL}|\b(?:emiratis|saudis)\b)\s*-?\s*only\b",
    rf"\bonly\s+(?:for\s+|to\s+)?{_NATIONS}\s+{_NATIONAL}",
    rf"\(\s*{_NATIONS}\s+nationals?(?:\s+only)?\s*\)",
    rf"\b(?:open|restricted|limited|reserved)\s+(?:only\s+|exclusively\s+)?(?:to|for)\s+(?:an?\s+)?{_NATIONS}\s+{_NATIONAL}(?:\s+(?:fresh\s+)?(?:graduates?|students?)\b)?",
    rf"\b(?:must|should|needs?\s+to|required\s+to|have\s+to|expected\s+to)\s+be\s+(?:an?\s+)?(?:[\w-]+\s+)?{_NATIONS}\s+{_NATIONAL}",
    rf"\b(?:must|should)\s+(?:hold|have|possess)\s+(?:an?\s+)?(?:valid\s+)?{_NATIONS}\s+(?:citizenship|nationality|passport)\b",
    rf"{_NATIONS}\s+(?:nationals?|passport|citizenship|nationality)\s+(?:is\s+|are\s+)?(?:required|mandatory|holders?)\b",
    rf"\bnationality\s*:\s*{_NATIONS}\b(?:\s+nationals?\b)?",
    rf"(?:{_NATIONS}\s+nationals?\b[^.;\n]{{0,40}}?)?\bfamily\s+book\b",
    rf"\baimed\s+at\s+(?:preparing|developing|training)\s+{_NATIONS}\s+{_NATIONAL}",
    rf"\bfor\s+(?:[\w-]+\s+)?{_NATIONS}\s+nationals?\s+(?:fresh\s+)?(?:students|graduates|undergraduates|trainees|interns)\b",
    rf"\b(?:seeking|seeks|looking\s+for|recruiting|hiring)\s+(?:an?\s+)?(?:{_ADJECTIVE}\s+(?:and\s+)?){{0,3}}{_NATIONS}\s+(?:{_NATIONAL}|nationals?\s+(?:fresh\s+)?(?:graduates?|students?|candidates|talent)\b)",
    rf"{_NATIONS}\s+national\s+(?:graduate|pre-graduate|trainee|internship|development)\s+(?:[\w-]+\s+)?program(?:me)?s?\b",
)
_SC_DV = r"(?-i:SC|DV|eDV|EDV)"
CLEARANCE_STATED = (
    r"\bsecurity[\s-]+(?:clearances?|cleared|vetting)\b",
    rf"\b{_SC_DV}(?:[\s-]+level)?[\s-]+(?:clearances?|cleared|clearable|eligib(?:le|ility))\b",
    r"(?-i:\beDV\b)",
    rf"\b(?:active|current|valid)\s+(?:{_SC_DV}(?:[\s-]+clearance)?\b|security\s+clearance\b)",
    r"\b(?:hold|holds|holding|have|has|having|with)\s+(?:an?\s+)?(?:active|current|valid)\s+clearance\b(?!\s+(?:rates?|status|certificates?|of|times?|process(?:es)?|levels?))",
    r"\b(?:uksv|nppv\s?\d?)\b",
    r"\bdeveloped\s+vetting\b",
    rf"\beligib(?:le|ility)\s+(?:to\s+(?:obtain|attain|gain|achieve|hold)|for)\s+(?:an?\s+)?(?:UK\s+)?{_SC_DV}\b",
)
BAR_SENTENCE_END = r"[.!?;](?=\s|$)|[\n\u2022\u00b7]"
BAR_CLAUSE_START = r"[.;!?\n(),\u2022\u00b7]"
BAR_NEGATED_BEFORE = r"(?:\b(?:no|not|never|without|nor)\b|n't\b)(?:\s+[\w/-]+){0,3}\s*$"
BAR_NEGATED_AFTER = (
    r"^\s*(?:[:(-]\s*|(?:is|are|will\s+be)\s+)(?:not|none|n/a|no|never)\b|^\s*(?:is|are)n't\b"
    r"|^[^.;\n]{0,30}?\bnot\s+(?:required|needed|necessary|essential|mandatory|a\s+requirement)\b"
)
_SOFT = (
    r"(?:ideally|prefer(?:red|ably|able|ence)?|desirable|desired|nice\s+to\s+have|bonus|a\s+plus|advantage(?:ous)?|encourage[ds]?|welcome[ds]?|priority"
    r"|prioriti[sz]e[ds]?|particularly|especially)"
)
BAR_SOFT_BEFORE = rf"\b{_SOFT}\b"
BAR_SOFT_AFTER = rf"^\s*[()]?\s*(?:(?:is|are|would|will|be|also|highly|strongly|particularly|especially|very|much|an?|given|significant|real|big|definite)\s+){{0,4}}{_SOFT}\b"
BAR_SOFT_IN_CLAUSE = r"\b(?:preferred|preferable|desirable|desired|advantage(?:ous)?|a\s+plus|nice\s+to\s+have|would\s+be\s+nice|beneficial|not\s+essential)\b"
BAR_HEDGED_BEFORE = (
    r"\b(?:(?:some|many|certain|most)\s+(?:of\s+(?:our|the)\s+)?(?:[\w-]+\s+){0,2}?roles|depending\s+on|(?:may|might|could)\s+(?:also\s+)?(?:need|require"
    r"|be\s+(?:required|needed|asked|subject))|(?:if|where)\s+(?:required|applicable|necessary)|prerequisite\s+for|preference\s+(?:will|may|shall|is)\s+(?:be\s+)?given)\b"
)
BAR_HEDGED_AFTER = r"^[^.;\n]{0,40}?\b(?:(?:may|might|could)\s+(?:also\s+)?(?:be\s+)?(?:required|needed|necessary)|(?:if|where)\s+(?:required|applicable|necessary)|depending\s+on)\b"
BAR_ALTERNATIVE = (
    r"\b(?:visas?|residen(?:ce|cy|ts?)|expat(?:riate)?s?|(?:any|all|other)\s+nationalit(?:y|ies)|non[\s-]nationals?|international\s+(?:candidates|applicants|students|talent))\b"
    r"|(?:/|\bor\b)\s*any\b"
)
BAR_OR_ALTERNATIVE = (
    r"^[^.;\n]{0,60}?(?:\bor\b|\band\s+(?:those|anyone|others|people|candidates|applicants|(?:\w+\s+)?(?:nationals|citizens))\s+(?:with|who)\b)[^.;\n]{0,60}?"
    r"\b(?:right\s+to\s+work|(?:indefinite\s+)?leave\s+to\s+remain|(?:pre-)?settled\s+status|ilr|green\s+card|eligible\s+to\s+work|permanent\s+residen\w*)\b"
)
CLEARANCE_DUTY = (
    r"\b(?:process(?:es|ing)?|manag(?:e|es|ing)|administer(?:s|ing)?|support(?:s|ing)?|coordinat(?:e|es|ing)|handl(?:e|es|ing)|run(?:s|ning)?"
    r"|track(?:s|ing)?|report(?:s|ing)?(?:\s+on)?|monitor(?:s|ing)?|advis(?:e|es|ing)(?:\s+on)?)\b(?:\s+[\w/-]+){0,2}\s*$"
    r"|^\s*(?:maintain|sponsor)\s+(?!(?:your|their)\b)(?:[\w/-]+\s+){0,2}$|\b(?:help(?:s|ing)?|assist(?:s|ing)?)\s+(?:[\w-]+\s+){0,2}?(?:to\s+)?"
    r"obtain\s+$|\b(?:clients|customers)\s+(?:to\s+)?obtain(?:ing)?\s+$"
)
CLEARANCE_HOLDERS = (
    r"\b(?:customers|clients|users|colleagues|partners|contractors|suppliers|employees|new\s+joiners)\s+(?:(?:who|that)\s+)?"
    r"(?:(?:hold|holds|have|has|with|holding)\s+(?:an?\s+)?(?:(?:active|current|valid)\s+)?)?$"
)
CLEARANCE_WORK_AFTER = (
    r"^\s*(?:[\w-]+\s+)?(?:applications?|requests?|teams?|unit|department|function|office|officers?|managers?|specialists?|administrators?"
    r"|coordinators?|advis[eo]rs?|processes|requirements|registers?|records|colleagues|customers|clients)\b"
)
CLEARANCE_PEERS = r"\b(?:work(?:s|ing)?\s+(?:closely\s+)?(?:with|alongside)|alongside|among(?:st)?|fellow|other)\s+(?:[\w-]+\s+){0,2}$"
QUESTION_AFTER = r"^[^.!;\n]*\?"

# Levels and fields in order; the first that a title names holds.
LEVELS = (
    ("graduate_entry", r"\b(?:graduate|grad|intern|internship|placement|entry[- ]level|trainee|apprentice)\b"),
    ("junior", r"\b(?:junior|jr|assistant)\b"),
    ("lead_principal", (
        r"\b(?:principal|director|head\s+of|staff\s+(?:[\w&/-]+\s+){0,3}?(?:engineer|developer|scientist|analyst|architect)|(?:tech|technical|team)\s+lead"
        r"|lead\s+(?!gen(?:eration)?\b)(?:(?-i:[A-Z])[\w&/-]*\s+){0,2}?(?:engineer|developer|scientist|analyst|data|architect|ml|ai)|lead(?=\s*(?:$|[-\u2013\u2014,(|/:])))\b"
    )),
    ("senior", r"\b(?:mid[- ]senior|senior|sr)\b"),
    ("mid", r"\b(?:mid[- ]level|intermediate)\b"),
)
FIELDS = (
    ("ai_llm", r"\b(?:machine\s+learning|ml\s+engineer(?:ing|s)?|mlops|ai\s+(?:\w+\s+)?engineer(?:ing|s)?|ai/ml|llm|nlp|deep\s+learning|computer\s+vision|generative\s+ai|applied\s+scientist)\b"),
    ("data_engineering", r"\b(?:data\s+engineer(?:ing|s)?|analytics\s+engineer(?:ing|s)?|etl|data\s+platforms?|big\s+data|data\s+architect|dataops|data\s+pipelines?)\b"),
    ("data_science", r"\b(?:data\s+scientists?|data\s+science|quantitative\s+research(?:er)?|quant\s+research(?:er)?|statistician|research\s+scientist)\b"),
    ("analytics_bi", r"\b(?:data\s+analyst|bi\s+analyst|bi\s+developer|business\s+intelligence|reporting\s+analyst|insights\s+analyst|power\s+bi|tableau\s+developer)\b"),
    ("quant", r"\b(?:quant(?:itative)?\s+(?:analysts?|traders?|developers?|strategists?|trading)|algorithmic\s+trading|systematic\s+trading)\b"),
    ("product", r"\bproduct\s+(?:managers?|owners?|analysts?|management|associates?|interns?|internships?)\b"),
    ("software", r"\b(?:software\s+engineer|software\s+developer|backend|back-end|frontend|front-end|full\s+stack|fullstack|full-stack|devops|site\s+reliability|sre|mobile\s+developer|ios\s+developer|android\s+developer)\b"),
    ("consulting", r"\b(?:consultants?|consulting|advisory\s+(?:analysts?|associates?)|(?:business|digital)\s+transformation)\b"),
    ("finance", (
        r"\b(?:m\s*&\s*a|mergers\s+and\s+acquisitions|investment\s+banking|investment\s+(?:analysts?|associates?|bankers?)|equity\s+research|private\s+equity|venture\s+capital"
        r"|asset\s+management|portfolio\s+(?:analysts?|management)|(?:financial|finance|credit|valuation|treasury)\s+(?:\w+\s+)?analysts?|market\s+analysts?"
        r"|(?:energy|power|gas|oil|commodit(?:y|ies)|carbon)\s+(?:market\s+)?analysts?|traders?|trading)\b"
    )),
)
ANALYTIC_TITLE = r"\b(?:data|analy\w*|scien(?:ce|tists?)|quant\w*|insights?|statistic\w*)\b"
# Titles of programmes that open again every year.
PROGRAMME_TITLE = (
    r"\b(?:interns?|internships?|placements?(?![\s-]+(?:manager|officer|co-?ordinator|consultant|lead|director|specialist|advis[eo]r)s?\b)"
    r"|graduates?(?:[\s-]+[\w&]+){0,3}?[\s-]+(?:programmes?|programs?|schemes?|trainees?)|(?:summer|spring|winter)[\s-]+(?:analyst|associate|internship|week|student)s?"
    r"|vacation[\s-]+(?:schemes?|programmes?|programs?|internships?)|off[\s-]?cycle|insight[\s-]+(?:day|week|programme|program)s?)\b"
)
# An invoice's total, and words that mark another amount.
NOT_THE_TOTAL = r"\b(?:subtotal|vat|previous balance|paid)\b"
TOTAL_DUE = r"(?:total|amount)(?: now)? due:?\s*(?:£|€|\$|EUR |USD )\s?(\d[\d,]*(?:\.\d+)?)"
# fmt: on
