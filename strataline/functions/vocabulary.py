"""Word lists and code tables of the cohort scripts, kept as plain configuration."""

# Words in the free-text history that set each disease flag.
HISTORY_WORDS = {
    "hypertension": ["고혈압", "혈압약", "HTN"],
    "diabetes": ["당뇨", "DM"],
    "hyperlipidemia": ["고지혈증", "Hyperlipidemia"],
    "cardiac_disease": [
        "심부전", "협심증", "부정맥", "심혈관", "심근경색", "스탠트", "스텐드", "심장약", "심장",
        "MI", "CAOD", "PTCA", "Atrial tachycardia", "Cardiomegaly", "AMI", "HF",
    ],
    "stroke": ["뇌졸중"],
}

# Smoking answers that count as smoker, and family-history answers that mean "none".
SMOKER = ["^O", "^P$", "Current smoker"]
NO_FAMILY_HISTORY = ["N", "X", "없음"]

# Schooling text to years of education, first match wins.
SCHOOLING_YEARS = [
    ("^무학", 0.0), ("^초중퇴", 3.0), ("^초졸", 6.0), ("^중중퇴", 7.5), ("^중졸", 9.0),
    ("^고중퇴", 10.5), ("^고졸", 12.0), ("^전문대졸", 14.0), ("^전대졸", 14.0),
    ("^초급대졸", 14.0), ("^대중퇴", 14.0), ("^대졸", 16.0), ("^대학원졸", 18.0), ("^석사", 18.0),
]

# Words for relatives and their code digit; mother and father together give 3.
RELATIVE_WORDS = [
    (["어머니"], "1"), (["아버지"], "2"), (["자매", "동생", "누나", "언니"], "4"),
    (["할머니", "외가", "이모"], "5"),
]
BOTH_PARENTS = ("12", "3")

# Sex codes.
SEX_NAMES = {"M": "Male", "F": "Female", "남": "Male", "여": "Female"}
SEX_NUMBERS = {"Male": 1, "Female": 2}

# Genotype texts.
GENOTYPE_NAMES = {"hom": "homozygous mutant type", "het": "heterozygous mutant type"}
WILD_TYPE = "homozygous wild type"
NORMAL = "normal"
INTRONIC = (".", "intronic SNV")

# Upper bounds of the delay bins (right-closed, the lowest bound included).
DELAY_BREAKS = [1, 7, 14, 21, 28, float("inf")]

# Lower bounds of the cigarette bins (left-closed) and their codes.
SMOKING_BREAKS = [1, 10, 20, 30, 40, 60, float("inf")]
SMOKING_CODES = ["1", "2", "3", "4", "5", "6"]

# Titles and duties that mark a staff member as surveyed.
POSITION_PATTERN = r"^(조|부|초빙|객원)?교수$|^임상|의료원장|임상강사|소장|전공의"
DUTY_PATTERN = "|".join([
    "(연구부|병|진료부)원장", "(교육수련|내과)부장", "(외|심장내)과장",
    "(노인의학|원격의료|진료협력|종합건강진단)센터장", "(병원문화혁신|건진)본부장", "(홍보|기획)실장",
])

# Names of the measurement and observation facts.
MEASUREMENT_CONCEPTS = {
    "MMSE": "Mini mental test examination",
    "CDR": "Clinical dementia rating",
    "CDR_Sum of box": "Clinical dementia rating-sum of boxes",
    "GDS": "Geriatric depression scale",
}
VITAL_CONCEPTS = {
    "height": "Height", "weight": "Weight", "SBP": "Systolic blood pressure",
    "DBP": "Diastolic blood pressure", "pulse": "Pulse rate",
}
OBSERVATION_CONCEPTS = {
    "Family_history_of_dementia": ("Family history", "Dementia"),
    "Smoking": ("Smoking", "TRUE"),
    "Hypertension": ("Past history", "Hypertension"),
    "Diabetes": ("Past history", "Diabetes"),
    "Hyperlipidemia": ("Past history", "Hyperlipidemia"),
    "Cardiac_disease": ("Past history", "Cardiac disease"),
}
