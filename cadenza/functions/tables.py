"""Word lists, look-up tables and patterns that results depend on."""

# fixed values
AUDIO_EXTENSIONS = [".flac", ".mp3", ".m4a", ".ogg", ".wav"]

# fixed values
GENRE_NAMES = {
    "Hip-Hop": "Hip-Hop/Rap", "Hip Hop": "Hip-Hop/Rap", "Rap": "Hip-Hop/Rap", "Rnb": "R&B", "R&B": "R&B/Soul",
    "Electronic": "Electronic", "Dance": "Dance", "House": "House", "Pop/Rock": "Pop", "Drum And Bass": "Drum & Bass",
    "Synthpop": "Synth-pop", "Alternative Rock": "Alternative", "Indie Rock": "Indie",
}

# fixed values
BROAD_GENRES = [
    "hip hop", "rap", "trap", "r&b", "soul", "pop", "rock", "metal", "jazz", "blues", "electronic", "dance", "house", "techno",
    "indie", "alt", "folk", "country", "regae", "reggae", "punk", "funk", "disco", "classical", "ambient", "lo-fi", "drill",
    "grime", "dubstep", "electro", "synth", "wave", "latin", "reggaeton", "garage", "dancehall", "ska", "ska-punk", "hardcore",
    "grunge", "progressive", "psychedelic", "experimental", "instrumental", "vocal", "acoustic", "orchestral",
]

# fixed values
GENRE_BLACKLIST = [
    "Billboard", "Hot 100", "Top 40", "Amazon", "Itunes", "Unknown", "Release", "Music", "Digital", "Various", "Wes",
    "Christoph Andersson", "Produced By", "Written By", "Mixed By", "Mastered By", "Engineer", "Composer",
]

# fixed values
BRACKET_KEYWORDS = ["official", "video", "audio", "flac", "mp3", "320", "hq", "hd", "rip"]

# fixed values
LYRICS_JUNK = [
    r"^\d+\s*(?:Contributor|Translation|Embed)s?$",
    r"^You might also like$",
    r"^Read More$",
    r"^See .* Live(?:Get tickets.*)?$",
    r"^\[?(?:Produced|Written|Arranged|Composed|Mastered|Mixed|Recorded|Engineered)\b.*\]?$",
    r"^\[?(?:Producer|Writer|Composer|Arranger|Engineer|Mixer|Release Date|Recording Date|Studio|Label)s?\s*:.*\]?$",
    r"^https?://\S+$",
    r"^www\.\S+$",
    r"^Synced by \S+$",
]

# fixed values
ARTIST_ALIASES = {
    "matasaru leonard george": "M.G.L.",
    "matasaru george leonard": "M.G.L.",
    "mătăsaru leonard george": "M.G.L.",
    "mătăsaru george leonard": "M.G.L.",
    "mătăsaru george-leonard": "M.G.L.",
    "m.g.l": "M.G.L.",
    "mgl": "M.G.L.",
    "stefan avram cherescu": "Nane",
    "ștefan avram cherescu": "Nane",
    "stefan cherescu": "Nane",
    "ștefan cherescu": "Nane",
    "nane": "Nane",
    "ionut raducanu": "Killa Fonic",
    "ionuț răducanu": "Killa Fonic",
    "ionut rapciug": "Killa Fonic",
    "ionuț răpciug": "Killa Fonic",
    "killa fonic": "Killa Fonic",
    "anghel georgian bogdan": "Ian",
    "bogdan georgian anghel": "Ian",
    "ian": "Ian",
    "andrew edward nedelcu": "Azteca",
    "andrew-edward nedelcu": "Azteca",
    "hameed amil": "Amuly",
    "alexandru mincu": "Amuly",
    "raduly ioan marian": "Bvcovia",
    "ioan marian raduly": "Bvcovia",
    "ravanelli florin oita": "Rava",
    "ravanelli florin oiță": "Rava",
    "ghinea alexandru daniel": "Noua Unspe",
    "darius vlad cretan": "Nosfe",
    "darius vlad crețan": "Nosfe",
    "bogdan david ionita": "Keed",
    "bogdan david ioniță": "Keed",
    "catalin guta": "Super ED",
    "cătălin guță": "Super ED",
    "vlad munteanu": "DOC",
    "vlad-costin munteanu": "DOC",
    "razvan eremia": "Deliric",
    "răzvan eremia": "Deliric",
    "deliric": "Deliric",
    "marius stelian craciun": "Cedry2k",
    "marius stelian crăciun": "Cedry2k",
    "mihai adamescu": "Chimie",
    "dragos tudorache": "Dragonu'",
    "dragoș tudorache": "Dragonu'",
    "b.u.g. mafia": "B.U.G. Mafia",
    "bug mafia": "B.U.G. Mafia",
    "stefan mihalache": "Connect-R",
    "ștefan mihalache": "Connect-R",
    "laurențiu mocanu": "Guess Who",
    "laurentiu mocanu": "Guess Who",
    "gabriel mihai istrate": "Shift",
    "andrei mihai maria": "Smiley",
    "andrei tiberiu maria": "Smiley",
    "elena alexandra apostoleanu": "Inna",
    "alin emil ghita": "El Nino",
    "alin emil ghiță": "El Nino",
    "maria alexandra florea": "Holy Molly",
    "adriana livia opris": "Olivia Addams",
    "adriana livia opriș": "Olivia Addams",
}
