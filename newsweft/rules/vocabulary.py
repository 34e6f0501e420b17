"""Rule vocabulary: categories, category rules, anchors, noise and stop words.

Everything in this module is a FIXED VALUE table.  The texts, weights and their
order decide the results, so they are stated plainly.  Callers may pass their
own tables instead (see :class:`newsweft.rules.book.RuleBook`).
"""

# Fixed values: (name, label, tag); the order is the category order used in ties.
CATEGORIES = [
    ("UkraineWar", "Ukraine war", "UKR"),
    ("MiddleEast", "Middle East", "MEA"),
    ("ArmedConflict", "Armed conflict", "WAR"),
    ("Terrorism", "Terrorism", "TER"),
    ("Unrest", "Unrest / coup", "UNR"),
    ("Earthquake", "Earthquake", "EQK"),
    ("NaturalDisaster", "Natural disaster", "NAT"),
    ("WeatherClimate", "Weather / climate", "WXC"),
    ("Health", "Health / epidemic", "HLT"),
    ("Migration", "Migration", "MIG"),
    ("Cyber", "Cyber", "CYB"),
    ("Economy", "Economy", "ECO"),
    ("Politics", "Politics / diplomacy", "POL"),
    ("Other", "Other", "GEN"),
]

# Severity level, label, heat weight.
SEVERITIES = [
    (0, "INFO", 1.0),
    (1, "WATCH", 1.4),
    (2, "ELEV", 2.0),
    (3, "SEVERE", 3.0),
    (4, "CRIT", 4.5),
]

# Category, weight, keywords (43 rules).
CATEGORY_RULES = [
    ("UkraineWar", 9, "ukraine war;war in ukraine;russian invasion;invasion of ukraine"),
    ("UkraineWar", 6, "zelensky;zelenskyy;kremlin offensive;russian strike;russian drone;russian missile"),
    ("UkraineWar", 5, "kharkiv;kherson;zaporizhzhia;bakhmut;donetsk;luhansk;donbas;mariupol;pokrovsk;avdiivka;kramatorsk"),
    ("UkraineWar", 4, "ukrainian forces;ukrainian troops;ukrainian drone;kyiv;crimea;black sea fleet"),
    ("UkraineWar", 3, "ukraine;ukrainian;russia;russian"),
    ("MiddleEast", 9, "gaza war;israel-hamas;israel hamas;war in gaza"),
    ("MiddleEast", 6, "gaza;hamas;hezbollah;houthi;houthis;idf;west bank;rafah;khan younis"),
    ("MiddleEast", 5, "israel;israeli;palestinian;palestinians;netanyahu;ceasefire in gaza"),
    ("MiddleEast", 4, "lebanon;beirut;iran;tehran;irgc;syria;damascus;yemen;red sea;houthi attack"),
    ("ArmedConflict", 8, "civil war;armed conflict;offensive;frontline;front line;rebels seize;junta forces"),
    ("ArmedConflict", 7, "airstrike;air strike;shelling;artillery;drone strike;missile strike;bombardment"),
    ("ArmedConflict", 6, "killed in fighting;clashes;militants;insurgents;paramilitary;rsf;m23;al-shabaab;boko haram;taliban"),
    ("ArmedConflict", 5, "troops;soldiers;military operation;mobilisation;mobilization;war crimes"),
    ("ArmedConflict", 4, "army;militia;combat;ambush;siege"),
    ("Terrorism", 9, "terror attack;terrorist attack;suicide bombing;suicide bomber"),
    ("Terrorism", 7, "islamic state;isis;isil;al-qaeda;al qaeda;claimed responsibility;car bomb;bomb attack"),
    ("Terrorism", 5, "hostage;kidnapping;gunman;mass shooting;stabbing attack"),
    ("Unrest", 8, "coup;coup attempt;military takeover;state of emergency;martial law"),
    ("Unrest", 7, "protests;protesters;riots;rioting;uprising;demonstrations;crackdown"),
    ("Unrest", 5, "strike action;unrest;clashes with police;tear gas;curfew"),
    ("Earthquake", 10, "earthquake;magnitude;aftershock;seismic;epicentre;epicenter;quake"),
    ("Earthquake", 7, "tsunami warning;tsunami"),
    ("NaturalDisaster", 9, "volcano;volcanic eruption;landslide;mudslide;avalanche;sinkhole"),
    ("NaturalDisaster", 8, "flood;flooding;floods;flash flood;deluge;inundated"),
    ("NaturalDisaster", 8, "wildfire;wildfires;bushfire;forest fire"),
    ("NaturalDisaster", 7, "cyclone;hurricane;typhoon;tropical storm;storm surge;tornado"),
    ("NaturalDisaster", 6, "drought;famine;locust"),
    ("NaturalDisaster", 6, "disaster;evacuated;evacuation;rescuers;death toll;collapsed building"),
    ("WeatherClimate", 7, "heatwave;heat wave;record temperature;cold snap;blizzard;climate change;global warming"),
    ("WeatherClimate", 5, "el nino;la nina;glacier;sea level;emissions;cop29;cop30;carbon"),
    ("Health", 9, "outbreak;epidemic;pandemic;cholera;ebola;mpox;measles;polio;bird flu;h5n1"),
    ("Health", 6, "who declares;public health emergency;quarantine;vaccination campaign;infections"),
    ("Health", 4, "hospital;virus;disease;malnutrition"),
    ("Migration", 8, "refugees;refugee camp;displaced;asylum seekers;migrant boat;migrants drowned"),
    ("Migration", 5, "migration;border crossing;deportation;smugglers"),
    ("Cyber", 9, "cyberattack;cyber attack;ransomware;data breach;hacked;hackers"),
    ("Cyber", 5, "malware;phishing;ddos;espionage campaign;spyware"),
    ("Economy", 7, "inflation;recession;central bank;interest rates;stock market;currency crisis"),
    ("Economy", 6, "sanctions;tariffs;trade war;oil prices;opec;default on debt;imf bailout"),
    ("Economy", 4, "economy;economic;gdp;unemployment"),
    ("Politics", 7, "election;elections;parliament;prime minister;president;summit;peace talks;negotiations"),
    ("Politics", 5, "diplomatic;ambassador;united nations;security council;nato;european union;treaty;resolution"),
    ("Politics", 4, "government;minister;vote;policy;sanctions lifted"),
]

# Id, category, title, decisive terms, supporting terms, home place (17 anchors).
ANCHORS = [
    ("ukraine-war", "UkraineWar", "Russia-Ukraine war",
     "ukraine;ukrainian;ukrainians;zelensky;zelenskyy;kharkiv;kherson;zaporizhzhia;donetsk;luhansk;donbas;donbass;"
     "bakhmut;pokrovsk;avdiivka;kramatorsk;mariupol;odesa;odessa;mykolaiv;chernihiv",
     "russia;russian;kremlin;kyiv;kiev;crimea;moscow;drone strike;missile strike;front line;frontline", "Ukraine"),
    ("gaza-war", "MiddleEast", "Israel-Gaza war",
     "gaza;gazan;hamas;rafah;khan younis;khan yunis;west bank",
     "israel;israeli;palestinian;palestinians;idf;netanyahu;hostage;hostages;ceasefire", "Gaza"),
    ("lebanon-israel", "MiddleEast", "Israel-Lebanon / Hezbollah front",
     "hezbollah;southern lebanon;south lebanon",
     "lebanon;lebanese;beirut;israeli strike;cross-border", "Southern Lebanon"),
    ("iran-tensions", "MiddleEast", "Iran confrontation",
     "irgc;iranian nuclear", "iran;iranian;tehran;enrichment;nuclear;hormuz;sanctions", "Iran"),
    ("red-sea", "MiddleEast", "Red Sea shipping crisis",
     "houthi;houthis;bab al-mandab;bab el-mandeb", "red sea;shipping;tanker;cargo ship;aden", "Red Sea"),
    ("syria", "MiddleEast", "Syria",
     "syria;syrian;damascus;aleppo;idlib;latakia", "assad;kurdish forces;sdf;insurgents", "Syria"),
    ("sudan-war", "ArmedConflict", "Sudan civil war",
     "sudan;sudanese;khartoum;darfur;el fasher;omdurman",
     "rsf;rapid support forces;janjaweed;famine", "Sudan"),
    ("sahel", "ArmedConflict", "Sahel insurgency",
     "sahel;jnim", "mali;burkina faso;niger;junta;wagner;africa corps;jihadist", "Sahel"),
    ("drc-m23", "ArmedConflict", "DR Congo / M23 conflict",
     "m23;north kivu;goma;bukavu", "dr congo;drc;congolese;rwanda;rwandan;kinshasa", "North Kivu"),
    ("myanmar", "ArmedConflict", "Myanmar civil war",
     "myanmar;burma;burmese;rohingya;naypyidaw", "junta;rakhine;arakan army;resistance;yangon", "Myanmar"),
    ("nigeria-lake-chad", "ArmedConflict", "Nigeria / Lake Chad insurgency",
     "boko haram;iswap", "nigeria;nigerian;lake chad;borno;maiduguri;kidnapped", "Nigeria"),
    ("haiti", "Unrest", "Haiti gang crisis",
     "haiti;haitian;port-au-prince", "gangs;gang;kenyan police;transitional council", "Haiti"),
    ("taiwan-strait", "Politics", "Taiwan Strait tensions",
     "taiwan strait;pla drills", "taiwan;taipei;china;beijing;incursion;airspace", "Taiwan Strait"),
    ("korea", "Politics", "Korean peninsula",
     "north korea;dprk;pyongyang;kim jong un", "south korea;seoul;missile test;ballistic;launch", "North Korea"),
    ("south-china-sea", "Politics", "South China Sea disputes",
     "south china sea;spratly;scarborough shoal;second thomas shoal",
     "philippines;china coast guard;vessel;water cannon", "South China Sea"),
    ("venezuela", "Politics", "Venezuela crisis",
     "venezuela;venezuelan;maduro;caracas", "essequibo;guyana;opposition;election", "Venezuela"),
    ("maghreb", "Politics", "Maghreb tensions",
     "western sahara;polisario", "algeria;morocco;sahrawi;tindouf", "Western Sahara"),
]

# Phrases that veto an item (53 terms).
NOISE_TERMS = (
    "premier league;champions league;la liga;serie a;bundesliga;world cup;nba;nfl;mlb;nhl;"
    "formula 1;grand prix;wimbledon;olympics;super bowl;transfer window;half-time;full-time;"
    "goalkeeper;touchdown;home run;test match;six nations;golf;tennis;cricket;rugby;"
    "box office;grammy;oscar;academy award;celebrity;red carpet;reality tv;netflix series;"
    "album release;tour dates;royal family;met gala;fashion week;horoscope;recipe;"
    "gift guide;deal of the day;best laptops;how to watch;streaming guide;video game;"
    "spoilers;season finale;dating app;weight loss;skincare"
).split(";")

# Words that never become tokens.
STOP_WORDS = (
    "the a an and or but of in on at to for from by with as is are was were be been "
    "being has have had do does did will would can could should may might must not no nor so if then than "
    "that this these those it its they them their there here what which who whom when where why how all any "
    "both each few more most other some such only own same too very just about after before over under again "
    "further once during into through above below out off down up more new news says say said report reports "
    "reported latest live update updates video watch photos photo world international breaking day week year "
    "years ago first last next amid after two three four five he she his her him you your we our us i"
).split()

# Severity terms, matched as plain substrings, most severe list first.
CRITICAL_TERMS = [
    "massacre", "genocide", "nuclear strike", "hundreds killed", "thousands killed",
    "mass casualties", "state of war", "declares war", "full-scale invasion",
]
SEVERE_TERMS = [
    "killed", "dead", "death toll", "casualties", "airstrike", "air strike", "bombing",
    "invasion", "offensive", "massive", "evacuate", "evacuation", "state of emergency",
    "disaster", "catastrophic", "devastating", "collapse", "coup",
]
ELEVATED_TERMS = [
    "wounded", "injured", "attack", "strike", "clashes", "warning", "alert", "threat",
    "escalation", "sanctions", "protest", "outbreak", "displaced", "missile", "drone",
]

# Casualty words in priority order.
TOLL_WORDS = ["killed", "dead", "died", "wounded", "injured", "missing", "displaced"]
