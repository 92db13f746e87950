"""Commands without arguments that stand for fixed text, as TeX sources on linguistics define them."""

from __future__ import annotations

#: Commands whose text is their own name.
_AS_NAMED = """
    ADESS ALL ANA AP ASP ASSERT ATT AUTOCAUS CL CONJ CONTR DEP DO E ELAT ESS ESSIVE EXT HAB HOR HUMAN ID IDEO IDPH IFV IMPF IMPV INCH INSTR INTENS IO
    LINK M MOD NC NEUT NONHUMAN NOUN NOUNPROPER NR NUM PART PAST PF PLU PN POSTP POT PREP PRES PRG PRIOR PRON PROSP PRV PSP RECIP RETRO SIM STR SUB
    TNS ts ° ᴵ ᵃ ᵉ ᵋ ᵒ ᵓ ᵘ ᶤ ᶶ ⁱ ꜜ
""".split()
#: Commands whose text is their name in capitals.
_CAPITAL = """
    Abl Abs Acc Act Ade Adj Adlzr Adv Agr All An Anim Ant Antip Aor Appl Appr Apud Art Asp Assoc At Aud Aug Aux Av Ben BrP Caus Cci Cf Char Cj Cl Clf
    Cmpl Cmpr Cnj Cntr Com Comp Compl Cond Conn Cont Cop Cr Cvb Dat Decl Def Dei Dem Dep Depend Desc Det Detr Dim Dir Disp Dist Distr Dj Do Dom Dptcl
    Dr Ds Du Dur Dv Ela Emph Ep Erg Es Etc EuP Evid Excl Expl Ext Foc Fs Fut Futimp Fv Gam Gen Genc Ger Hab Hyp Iam Ii Iii Ill Imm Imn Imp Impass Inch
    Incl Incmpl Ind Indef Indic Indir Ine Inf Infr Ins Int Intj Intr Ints Inv Invol Io Ipf Ipfv Irr Iter Iv Lat Lk Lnk Loc Lv Masc Med Mid Mnom Mr Mut
    Nact Ncm Ndu Neg Nfin Nmlz Nom Nonpast Npst Nsg Nth Num Nw Obj Obl Om Only Ov Part Pass Pauc Perm Pfv Pg Pip Pl Pn Pos Poss Pot Ppp Prdst Pred
    Prep Prf Priv Prog Proh Pron Prop Propn Pros Prov Prox Prs Prt Prv Pst Ptcl Ptcp Purp Pv Quot Rci Real Recog Recp Red Redup Refl Rel Rem Rep Res
    Rg Rm Rpst Rpt Rs Sbj Sbjv Sdu Sg Sim Simil Simp Sm Sr Ss Stat Subj Subl Supe Supl Ta Temp Term Th Ti Tns Tr Ut Vblz Vc Vm Vn Voc Vol abi abs acc
    add agnm ali allo am an antgen antip appl asp att augv aux ben bg caus cert clf cmpr cn coll com comp compl complx con cond conj conn cop cras cs
    ctopic cvb dat decl deff defn dem dep deter detr dir dist distr dsbj dscn du dubt dur dxm dyn ego egr epen erg excl expl faff fin foc fut gen hab
    hest icml ident ideo ideoph illa imp impr incep ind indf ines inf ingr intens intr ipfv irr itr lin loc mod modal mut nmlz nom nsg nts obj obl opt
    pass pda pfv pl poss postp pp prag pred prep prf prog proh propr prosp prox prs prtv psg pst pstcont pstpunc pstrem ptcp punc purp pvs qual quant
    rdp reas refl reln rep rls sbj semb sg sprl ssbj stat subj supperl them tmp tns uop vir voc wk
""".split()
#: Other commands, by their text.
_BY_TEXT: dict[str, str] = {
    "": "z",
    " [": "db",
    "\"": "textquotedbl",
    "&": "Aand",
    "'": "h",
    "(": "USOParen op",
    ")": "USCParen cp",
    "/": "slash",
    "1": "First firstperson",
    "1DU": "Fdu",
    "1NSG": "Fnsg",
    "1P": "oneP",
    "1PL": "Fpl",
    "1S": "oneS",
    "1SG": "Fsg",
    "2": "Second secondperson",
    "2NSG": "Snsg",
    "2P": "twoP",
    "2PL": "Spl",
    "2S": "twoS",
    "2SG": "Ssg",
    "2|3DU": "Stdu",
    "2|3NSG": "Stnsg",
    "2|3PL": "Stpl",
    "2|3SG": "Stsg",
    "3": "Third thirdperson",
    "3PL": "Tpl",
    "3S": "SSS",
    "3SG": "Tsg thirdsg",
    "4PL": "Fopl",
    "4SG": "Fosg",
    "<": "USSmaller textless",
    "<backslash>": "BS",
    ">": "USGreater textgreater",
    "A": "Aa",
    "ABESS": "ABESSs",
    "ACC": "ACCs",
    "ADNOM": "Anom",
    "AND": "Andat andat",
    "ATTR": "ATTRs",
    "B": "Bb",
    "COM": "COMs",
    "CONNEG": "CONNEGs",
    "DEF": "definite defsc",
    "DIST": "DISTs",
    "DU": "DUs",
    "ELAT": "ELATs",
    "EMPH": "emphat",
    "ESS": "ESSs",
    "F": "fem glossF",
    "GEN": "GENs glgen",
    "G_grade_(Muskogean)": "Gg",
    "I": "Ig",
    "ILL": "ILLs",
    "IMP": "IMPs",
    "INESS": "INESSs",
    "INF": "INFs glinf glossINF",
    "INS": "instr",
    "INTR": "INT",
    "IPST": "Immpst",
    "J": "Jj",
    "L": "Ll",
    "M": "MAS glossM mas masc",
    "N": "Ng Non glossN neu",
    "NEG": "NEGs glossNeg negation",
    "NFIN": "glta glte",
    "NOM": "NOMs",
    "N_VIR": "nvir",
    "O": "object",
    "OBJV": "Obv",
    "OPA": "glopa",
    "P": "Pp",
    "PART": "partic",
    "PARTICLE": "part",
    "PL": "PLs",
    "PM": "persm",
    "PN": "propnoun",
    "POL": "polite",
    "POT": "POTs",
    "PRED": "PREDs",
    "PRF": "PRFs",
    "PRO": "pronoun",
    "PROG": "PROGs glprog",
    "PROX": "PROXs",
    "PRS": "PRSs",
    "PST": "PSTs",
    "Q": "glossQ question",
    "R": "Rr",
    "REC": "Recip",
    "REFL": "REFLs",
    "REL": "relativ",
    "RES": "result",
    "RMT": "RMTs",
    "S": "Su",
    "SC2": "SC",
    "SC3": "SCC",
    "SEC": "Secun",
    "SG": "SGs glsg",
    "SIM": "simult",
    "SUP": "supp",
    "T": "Tt",
    "TOP": "Topic glme topi topic",
    "TR": "transitiv",
    "TRANS": "Transl",
    "TT": "Tto",
    "U": "Uu",
    "VBLZ": "Verb",
    "VEN": "ventiv",
    "VENT": "Venit",
    "VP": "sVP",
    "Y.N": "Yn",
    "[": "ob",
    "]": "cb",
    "_": "longrule",
    "`": "lw",
    "ề": "daeb",
    "ế": "dae",
    "l_PTCP": "lptcp",
    "lá": "la",
    "mbʉ̀ʉ́": "mbuLH",
    "mbʉ́ʉ̀": "mbuHL",
    "mb̀ʉ̀": "mbuL",
    "ndà": "nda",
    "ồ": "daob",
    "ố": "dao",
    "r": "R",
    "the": "thestrong theweak",
    "volition": "Volition",
    "~": "Tilde ns redp sq tld",
    "·": "textperiodcentered",
    "ầ": "daab",
    "ấ": "daa",
    "č": "paaf",
    "ħ": "het hetB phfr textcrh",
    "š": "pafr",
    "ɔ": "oo oor textopeno",
    "ɔ̀": "ooL",
    "ɔ́": "ooH",
    "ɖ": "D textrtaild",
    "ə": "schwa shw",
    "ə̀": "schwaL",
    "ə́": "schwaH",
    "ɛ": "textepsilon",
    "ɣ": "GH textgamma",
    "ɪ": "textsci",
    "ɬ": "textbeltl",
    "ɲ": "ny textltailn",
    "ɸ": "ph",
    "ʁ": "vuvfr",
    "ʃ": "shin shinB ssh",
    "ʄ": "F",
    "ʉ": "baru",
    "ʉ̀": "baruL",
    "ʉ́": "baruH",
    "ʒ": "zzh",
    "ʔ": "alef alefB glpl glst textglotstop textraiseglotstop",
    "ʕ": "ayin ayinB",
    "ʡ": "eppl",
    "ʤ": "gy",
    "ʧ": "tts",
    "ʷ": "lab",
    "ː": ": lmk",
    "ˤ": "pha",
    "̌": "rs",
    "Α": "Alph",
    "Β": "Bet",
    "Β1": "Betaone",
    "Β2": "Betatwo",
    "ε": "eer ep",
    "ὲ": "epL",
    "έ": "epH",
    "μ": "mo",
    "σ": "syl",
    "χ": "uvfr",
    "ṭ": "tet",
    "’": "ej",
    "→": "fl",
    "→3": "flobv",
    "∅": "USEmptySet",
    "≫": "rnk",
    "ꜜ": "ds textdownstep",
}
MACROS: dict[str, str] = {n: n for n in _AS_NAMED} | {n: n.upper() for n in _CAPITAL} | {n: text for text, names in _BY_TEXT.items() for n in names.split()} | dict.fromkeys(("Zero", "zero"), "∅")
#: Abbreviations of the Leipzig Glossing Rules.
LEIPZIG = """
    A ABL ABS ACC ADJ ADV AGR ALL ANTIP APPL ART AUX BEN CAUS CLF COM COMP COMPL COND COP CVB DAT DECL DEF DEM DET DIST DISTR DU DUR ERG EXCL F FOC
    FUT GEN IMP INCL IND INDF INF INS INTR IPFV IRR LOC M N NEG NMLZ NOM OBJ OBL P PASS PFV PL POSS PRED PRF PRS PROG PROH PROX PST PTCP PURP Q QUOT
    RECP REFL REL RES S SBJ SBJV SG TOP TR VOC
""".split()
ABBREVIATIONS: dict[str, str] = {form: a for a in LEIPZIG for form in (a, a.lower(), *([a.capitalize()] if len(a) > 1 else []))}
