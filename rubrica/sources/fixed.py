"""Data that must equal published inputs for right results.

Data types, rubric rows, check texts, lab columns and record layouts are
stated here as plain text in their natural order.  The entity model and the
check library are our own reconstruction (see README).
"""

from __future__ import annotations

# Data types (code, name, coded, numeric, range).
DATA_TYPES = (
    ("CD", "Coded", True, False, False),
    ("CE", "CodedElement", True, False, False),
    ("CWE", "CodeWithException", True, False, False),
    ("FT", "FreeText", False, False, False),
    ("NM", "Numeric", False, True, False),
    ("NR", "NumericRange", False, True, True),
    ("PQ", "PhysicalQuantity", False, True, False),
    ("REAL", "RealNumber", False, True, False),
    ("SN", "StructuredNumeric", False, True, False),
    ("ST", "String", False, False, False),
    ("TX", "Text", False, False, False),
)
DEFAULT_DATA_TYPE = "ST"
UNKNOWN_DATA_TYPE = "UNK"
QUALITATIVE_TYPES = "CE|CWE|CD|ST|FT|TX"

# Message error texts.
ERR_PAYLOAD = "Payload is not a JSON object."
ERR_PROVIDER = "Provider is missing."
ERR_SOURCE = "Data Source is missing."
ERR_MESSAGE_ID = "Message ID is missing."
ERR_NO_MODEL = "Missing model version mnemonic."
ERR_BAD_MODEL = "Invalid message model."
ERR_BAD_RUBRIC_MODEL = "Invalid evaluation model."
ERR_MODEL_MISMATCH = "Message model mnemonic does not match the evaluation rubric."
ERR_ROOT = "Root token not found"
# Texts of answers that checks give.
NOT_POPULATED_DATE = "Attribute data not populated. Check sam dependencies"
NO_PARAMETERS = "Parameter list was not supplied"
NOT_POPULATED = "Value is not populated. Check the prerequisites."

#: Request property that names the model, unless the caller says otherwise.
MODEL_PROPERTY = "ModelMnemonic"
MODEL_PATTERN = r"^(.*?)_V(\d+)(?:_(.*))?$"

# Lab sheet columns by position.
LAB_COLUMNS = (
    "UniqueID",
    "LongAccessionNumberUID",
    "LabChemTestSID",
    "LabChemTestName",
    "LabChemTestUrgencySID",
    "Urgency",
    "LabChemResultValue",
    "LabChemResultNumericValue",
    "TopographySID",
    "Topography",
    "AccessionInstitutionSID",
    "AccessioningInstitution",
    "OrderingInstitutionSID",
    "OrderingInstutionName",
    "CollectingInstitutionSID",
    "CollectingInstitutionName",
    "LOINCSID",
    "LOINC",
    "Units",
    "Abnormal",
    "RefHigh",
    "RefLow",
)
LOINC_OID = "2.16.840.1.113883.6.1"
UNIT_SYSTEM = "UCUM"
INTERPRETATION_OID = "2.16.840.1.113883.5.83"
DEFAULT_INTERPRETATION = "N"
LAB_VALUE_TYPE = "PQ"

# Columns of the flat audit file.
AUDIT_COLUMNS = (
    "runId",
    "rowNumber",
    "requestTimestamp",
    "responseTimestamp",
    "durationMs",
    "apiUrl",
    "messageId",
    "httpStatus",
    "wasSuccess",
    "attemptCount",
    "errorType",
    "errorMessage",
    "requestBody",
    "responseBody",
)

# Data class label -> message property.
CLASS_PATHS = (
    ("Allergies", "allergies"),
    ("Clinical Documents", "clinicalDocuments"),
    ("Conditions", "conditions"),
    ("Demographics", "demographics"),
    ("Diagnostic Imaging", "diagnosticImaging"),
    ("Encounters", "encounters"),
    ("Goals", "goals"),
    ("Health Assessments", "healthAssessments"),
    ("Immunizations", "immunizations"),
    ("Lab Results", "labResults"),
    ("Medical Devices", "medicalDevices"),
    ("Medications", "medications"),
    ("Procedures", "procedures"),
    ("Providers", "providers"),
    ("Vital Signs", "vitalSigns"),
)

# Entity model of the clinical message, one block per class:
#   class mnemonic, class property, cardinality
#     attribute mnemonic, property, type, display name when it differs
CLINICAL_MODEL = """
ALLERGIES allergies MANY
  ALG_REACT reaction CC
  ALG_SUB substance CC
  ALG_EFFDT effectiveDate ATR
  ALG_STATUS allergyStatus CC
DOCUMENTS clinicalDocuments MANY
  DOC_TYPE documentType CC
  DOC_EFFDATE effectiveDate ATR
  DOC_HAS_ATTACHMENT hasAttachment ATR
CONDITIONS conditions MANY
  CND_COND condition CC
  CND_ONDT onsetDate ATR
  CND_RESDT resolutionDate ATR
  CND_STATUS conditionStatus CC
DEMOGRAPHICS demographics ONE
  DEM_DOB birthDate ATR
  DEM_SEX birthSex CC
  DEM_DEATHDT deathDate ATR
  DEM_DECEASED deceased ATR
  DEM_ETHN ethnicity CC
  DEM_GENDER genderIdentity CC
  DEM_MARITAL maritalStatus CC
  DEM_ID patientIdentifier ATR
  DEM_LANG primaryLanguage CC
  DEM_RACE race CC
IMAGING diagnosticImaging MANY
  IMAGING_PROCEDURE procedure CC
  IMAGING_RPT_DATETIME reportDateTime ATR
  IMAGING_RPT_HASATTACHMENT hasAttachment ATR
ENCOUNTERS encounters MANY
  ENC_DATETIME encounterDateTime ATR encounter date/time
  ENC_DIAGNOSIS encounterDiagnosis CC encounter diagnosis
  ENC_DISPOSITION encounterDisposition CC encounter disposition
  ENC_ENDDATETIME encounterEndDateTime ATR encounter end date/time
  ENC_ID encounterIdentifier ATR encounter identifier
  ENC_LOCATION encounterLocation CC encounter location
  ENC_REASON encounterReason CC encounter reason
  ENC_STATUS encounterStatus CC encounter status
  ENC_TYPE encounterType CC encounter type
GOALS goals MANY
  GOAL_GOAL goal CC
  GOAL_EFFDATE effectiveDate ATR
HEALTHASSESSMENTS healthAssessments MANY
  HA_ITEM assessment CC
  HA_EFFDT effectiveDate ATR
  HA_ISSUEDT issueDateTime ATR
  HA_RESUOM resultUnit CC
  HA_RESVALUE resultValue OBSVAL
IMMUNIZATIONS immunizations MANY
  IMM_ADMDT administrationDate ATR
  IMM_VACC vaccine CC
  IMM_LOTNO lotNumber ATR
LABRESULTS labResults MANY
  LAB_ABFLAG abnormalFlag CC
  LAB_INTERP interpretation CC
  LAB_ORD order CC
  LAB_PERFDT performedDate ATR
  LAB_PERFSITE performingSite CC
  LAB_REFRNG referenceRange RV
  LAB_RESUOM resultUnit CC
  LAB_RESVALUE resultValue OBSVAL
  LAB_RSTAT resultStatus CC
  LAB_SPECTYPE specimenType CC
  LAB_TEST test CC
MEDICALDEVICES medicalDevices MANY
  DEV_TYPE deviceType CC
MEDICATIONS medications MANY
  MED_DRUG medication CC
  MED_STDT startDate ATR
  MED_DOSEAMT doseAmount ATR
  MED_DOSEAMTUOM doseUnit CC
  MED_IND indication CC
  MED_FSTAT fillStatus CC
PROCEDURES procedures MANY
  PRC_PROC procedure CC
  PRC_PERF_DATE procedurePerformedDate ATR procedure performed date
  PRC_STATUS procedureStatus CC procedure status
  PRC_PRCDT procedureDateTime ATR
  PRC_RSN procedureReason CC
PROVIDERS providers MANY
  PRV_NAME providerName ATR
VITALSIGNS vitalSigns MANY
  VIT_VITAL vitalSign CC
  VIT_RESUNIT resultUnit CC
  VIT_RESVALUE resultValue OBSVAL
  VIT_PERFDT performedDate ATR
"""

# Rubric rows,
#   sequence|entity|check|display name|failure name|effect|critical|conditional|parameter
# Every weight is 1.
CORE_DATA_V3 = """
1|LAB_TEST|CONCEPT_ISACTIVE|LOINC Code Active|Inactive LOINC Code|Informational|||
2|LAB_TEST|CONCEPT_ISVALIDMEMBER|Lab Test is LOINC|Lab Test not LOINC|Scoring|Critical||REGEN_LOINC
3|LAB_ORD|CONCEPT_ISVALIDMEMBER|Lab Order is LOINC|Lab Order not LOINC|Informational|||REGEN_LOINC
4|LAB_RESVALUE|CONCEPT_ISVALIDMEMBER|Lab Result is SNOMED-CT|Lab Result not SNOMED-CT|Scoring||OBSERVATIONVALUE_ISQUALITATIVE|SNO_INT_USEXT
5|LAB_RESUOM|ATTR_INEXTERNALLIST|Result Unit is UCUM|Result Unit not in UCUM|Scoring||ATTR_ISPOPULATED|UCUM
6|LAB_SPECTYPE|CONCEPT_ISVALIDMEMBER|Specimen Type is SNOMED-CT|Specimen Type not SNOMED-CT|Scoring||ATTR_ISPOPULATED|SNO_INT_USEXT
7|LAB_RSTAT|ATTR_ISPOPULATED|Result status is populated|Result status is unpopulated|Scoring|||
8|LAB_PERFDT|ATTR_ISPASTDATE|performed date is valid|performed date is invalid|Scoring|||
9|ALG_REACT|CONCEPT_ISVALIDMEMBER|Allergy Reaction is SNOMED-CT|Allergy Reaction is not SNOMED-CT|Scoring|||SNO_INT_USEXT
10|ALG_SUB|CONCEPT_ISVALIDMEMBER|Allergy Substance is RxNorm or SNOMED-CT|Allergy Substance is not RxNorm or SNOMED-CT|Scoring|||SNO_INT_USEXT,NLM_RXN
11|ALG_EFFDT|ATTR_ISPASTDATE|effective date is valid|effective date is invalid|Scoring|||
12|CND_COND|CONCEPT_ISVALIDMEMBER|Condition is SNOMED-CT or ICD10CM|Condition is not SNOMED-CT or ICD10CM|Scoring|||SNO_INT_USEXT,WHO_ICD10CM_FULL
13|CND_ONDT|ATTR_ISPASTDATE|Condition onset date is valid|Condition onset date is invalid|Scoring|||
14|CND_RESDT|ATTR_ISPASTDATE|Condition resolution date is valid|Condition resolution date is invalid|Scoring||ATTR_ISPOPULATED|
15|DEM_DOB|ATTR_ISPASTDATE|Date of birth is valid past date|Date of brith is invalid|Scoring|||
16|DEM_SEX|CONCEPT_ISVALIDMEMBER|Birth sex is SNOMED-CT|Birth sex not coded as SNOMED-CT|Scoring|||SNO_INT_USEXT
17|DEM_ETHN|CONCEPT_ISVALIDMEMBER|Ethnicity is valid code|Ethnicity is invalid|Scoring|||CDC_RE
18|DEM_RACE|CONCEPT_ISVALIDMEMBER|Race is valid concept|Race is invalid|Scoring|||CDC_RE
19|IMM_ADMDT|ATTR_ISPASTDATE|Immunization date is valid|Immunization date is invalid|Scoring|||
20|IMM_VACC|CONCEPT_ISVALIDMEMBER|Immunization is valid concept|Immunization is not valid concept|Scoring|||FDA_PACK,CDC_CVX
21|IMM_LOTNO|ATTR_ISPOPULATED|Immunization Lot number is populated|Immunization Lot number not populated|Scoring|||
22|MED_DRUG|CONCEPT_ISVALIDMEMBER|Medication is Compatible|Medication is invalid |Scoring|||NLM_RXN,FDA_PACK
23|MED_STDT|ATTR_ISPASTDATE|Medication date is valid|Medication date is invalid|Scoring|||
24|MED_DOSEAMT|ATTR_ISNUMERIC|Medication dose is a valid number|Medication dose is invalid|Scoring|||
25|MED_DOSEAMTUOM|ATTR_INEXTERNALLIST|Medication dose unit is valid|Medication dose unit is invalid|Scoring|||UCUM
26|MED_IND|ATTR_ISPOPULATED|Medication indication is populated|Medication indication not populated|Scoring|||
27|MED_FSTAT|ATTR_ISPOPULATED|Medication fill status is populated|Medication fill status not populated|Scoring|||
28|PRC_PROC|CONCEPT_ISVALIDMEMBER|Procedure is valid concept|Procedure is invalid|Scoring|||SNO_INT_USEXT,AMA_CPT
29|PRC_PRCDT|ATTR_ISPASTDATE|Procedure date is valid|Procedure date is invalid|Scoring|||
30|PRC_RSN|ATTR_ISPOPULATED|Procedure reason is populated|Procedure reason not populated|Scoring|||
31|ENC_DATETIME|ATTR_ISPASTDATE|Encounter date is in the past|Encounter date is in not the past|Scoring|||
32|ENC_DIAGNOSIS|CONCEPT_ISVALIDMEMBER|Diagnosis is SNOMED-CT or ICD-10-CM|Diagnosis is not SNOMED-CT or ICD-10-CM|Scoring|||SNO_INT_USEXT,WHO_ICD10CM_FULL
33|ENC_TYPE|ATTR_ISPOPULATED|Encounter type is populated|Encounter type is not populated|Scoring|||
34|ENC_DISPOSITION|ATTR_ISPOPULATED|Encounter disposition is populated|Encounter disposition is not populated|Scoring|||
35|ENC_LOCATION|ATTR_ISPOPULATED|Encounter location is populated|Encounter location is not populated|Scoring|||
36|VIT_VITAL|CONCEPT_ISVALIDMEMBER|Vital sign is valid concept|Vital sign is invalid|Scoring|||REGEN_LOINC
37|VIT_RESUNIT|ATTR_INEXTERNALLIST|Vital sign result unit is UCUM|Vital sign result unit is not UCUM|Scoring||ATTR_ISPOPULATED|UCUM
38|IMAGING_PROCEDURE|CONCEPT_ISVALIDMEMBER|Imaging Procedure is LOINC|Imaging Procedure is not LOINC|Scoring|||REGEN_LOINC
39|IMAGING_RPT_DATETIME|ATTR_ISPASTDATE|report date is valid|report date is invalid|Scoring|||
42|DOC_TYPE|CONCEPT_ISVALIDMEMBER|Document type is LOINC|Document type is not LOINC|Scoring|||REGEN_LOINC
43|DOC_EFFDATE|ATTR_ISPASTDATE|Document date is past date|Document date is not past date|Scoring|||
44|HA_ITEM|CONCEPT_ISVALIDMEMBER|Health status assessment is  LOINC or SNOMED-CT|Health status assessment is  not LOINC or SNOMED-CT|Scoring|||REGEN_LOINC,SNO_INT_USEXT
45|HA_EFFDT|ATTR_ISPASTDATE|Health Status assessment date is date in past|Health Status assessment date is not date in past|Scoring|||
46|GOAL_GOAL|ATTR_ISPOPULATED|goal is populated|goal is not populated|Scoring|||
47|GOAL_EFFDATE|ATTR_ISDATE|Goal date is valid|Goal date is invalid|Scoring|||
48|IMAGING_RPT_HASATTACHMENT|ATTRIBUTE_INDICATOR_IS_TRUE|Image has attachment|Image is missing attachment|Scoring|||
48|DOC_HAS_ATTACHMENT|ATTRIBUTE_INDICATOR_IS_TRUE|Document has attachment|Document does not have attachment|Scoring|||
"""

CORE_DATA_V2 = """
1|LAB_TEST|CONCEPT_ISVALIDMEMBER|Lab Test is LOINC|Lab Test not LOINC|Scoring|Critical||REGEN_LOINC
2|LAB_ORD|CONCEPT_ISVALIDMEMBER|Lab Order is LOINC|Lab Order not LOINC|Informational|||REGEN_LOINC
3|LAB_PERFDT|ATTR_ISPASTDATE|Performed date is valid|Performed date is invalid|Scoring|||
4|LAB_RESVALUE|ATTR_ISPOPULATED|Lab result value is populated|Lab result value is not populated|Scoring|Critical||
5|ALG_REACT|CONCEPT_ISVALIDMEMBER|Allergy Reaction is SNOMED-CT|Allergy Reaction is not SNOMED-CT|Scoring|||SNO_INT_USEXT
6|ALG_SUB|CONCEPT_ISVALIDMEMBER|Allergy Substance is RxNorm or SNOMED-CT|Allergy Substance is not RxNorm or SNOMED-CT|Scoring|||SNO_INT_USEXT,NLM_RXN
7|ALG_EFFDT|ATTR_ISPASTDATE|Effective date is valid|Effective date is invalid|Scoring|||
8|CND_COND|CONCEPT_ISVALIDMEMBER|Condition is SNOMED-CT or ICD10CM|Condition is not SNOMED-CT or ICD10CM|Scoring|||SNO_INT_USEXT,WHO_ICD10CM_FULL
9|CND_ONDT|ATTR_ISPASTDATE|Condition onset date is valid|Condition onset date is invalid|Scoring|||
10|CND_RESDT|ATTR_ISPASTDATE|Condition resolution date is valid|Condition resolution date is invalid|Scoring||ATTR_ISPOPULATED|
11|DEM_DOB|ATTR_ISPASTDATE|Date of birth is valid past date|Date of birth is invalid|Scoring|Critical||
12|DEM_SEX|CONCEPT_ISVALIDMEMBER|Birth sex is conformant|Birth sex not conformant|Scoring|Critical||HL7_ADMINGNDR
13|DEM_ETHN|CONCEPT_ISVALIDMEMBER|Ethnicity is valid code|Ethnicity is invalid|Scoring|||CDC_RE
14|DEM_RACE|CONCEPT_ISVALIDMEMBER|Race is valid concept|Race is invalid|Scoring|||CDC_RE
15|IMM_ADMDT|ATTR_ISPASTDATE|Immunization date is valid|Immunization date is invalid|Scoring|||
16|DEM_LANG|ATTR_ISPOPULATED|Primary language is populated|Primary language is not populated|Scoring|||
17|IMM_VACC|CONCEPT_ISVALIDMEMBER|Immunization is valid concept|Immunization is not valid concept|Scoring|||FDA_PACK,CDC_CVX
18|MED_DRUG|CONCEPT_ISVALIDMEMBER|Medication is valid concept|Medication is invalid |Scoring|||NLM_RXN,FDA_PACK
19|PRC_PROC|CONCEPT_ISVALIDMEMBER|Procedure is valid concept|Procedure is invalid|Scoring|||SNO_INT_USEXT,AMA_CPT,WHO_ICD10PCS_FULL
20|PRC_PERF_DATE|ATTR_ISPASTDATE|Performed date is valid|Performed date is invalid|Scoring|||
21|VIT_VITAL|CONCEPT_ISVALIDMEMBER|Vital sign is valid concept|Vital sign is invalid|Scoring|||REGEN_LOINC
22|VIT_RESUNIT|ATTR_INEXTERNALLIST|Vital sign result unit is UCUM|Vital sign result unit is not UCUM|Scoring||ATTR_ISPOPULATED|UCUM
23|VIT_PERFDT|ATTR_ISPASTDATE|performed date is valid|performed date is invalid|Scoring|||
"""

LAB = """
1|LAB_TEST|CONCEPT_ISACTIVE|LOINC Code Active|Inactive LOINC Code|Informational|||
2|LAB_TEST|CONCEPT_ISVALIDMEMBER|Lab Test is LOINC|Lab Test not LOINC|Scoring|Critical||REGEN_LOINC
3|LAB_ORD|CONCEPT_ISVALIDMEMBER|Lab Order is LOINC|Lab Order not LOINC|Informational|||REGEN_LOINC
4|LAB_RESVALUE|CONCEPT_ISVALIDMEMBER|Lab Result is SNOMED-CT|Lab Result not SNOMED-CT|Scoring||OBSERVATIONVALUE_ISQUALITATIVE|SNO_INT_USEXT
5|LAB_RESUOM|ATTR_INEXTERNALLIST|Result Unit is UCUM|Result Unit not in UCUM|Scoring||ATTR_ISPOPULATED|UCUM
6|LAB_SPECTYPE|CONCEPT_ISVALIDMEMBER|Specimen Type is SNOMED-CT|Specimen Type not SNOMED-CT|Scoring||ATTR_ISPOPULATED|SNO_INT_USEXT
7|LAB_RSTAT|ATTR_ISPOPULATED|Result status is populated|Result status is unpopulated|Scoring|||
8|LAB_PERFDT|ATTR_ISPASTDATE|performed date is valid|performed date is invalid|Scoring|||
9|ALG_REACT|CONCEPT_ISVALIDMEMBER|Allergy Reaction is SNOMED-CT|Allergy Reaction is not SNOMED-CT|Scoring|||SNO_INT_USEXT
10|ALG_SUB|CONCEPT_ISVALIDMEMBER|Allergy Substance is RxNorm or SNOMED-CT|Allergy Substance is not RxNorm or SNOMED-CT|Scoring|||SNO_INT_USEXT,NLM_RXN
11|ALG_EFFDT|ATTR_ISPASTDATE|effective date is valid|effective date is invalid|Scoring|||
12|CND_COND|CONCEPT_ISVALIDMEMBER|Condition is SNOMED-CT or ICD10CM|Condition is not SNOMED-CT or ICD10CM|Scoring|||SNO_INT_USEXT,WHO_ICD10CM_FULL
13|CND_ONDT|ATTR_ISPASTDATE|Condition onset date is valid|Condition onset date is invalid|Scoring|||
14|CND_RESDT|ATTR_ISPASTDATE|Condition resolution date is valid|Condition resolution date is invalid|Scoring||ATTR_ISPOPULATED|
15|DEM_DOB|ATTR_ISPASTDATE|Date of birth is valid past date|Date of brith is invalid|Scoring|||
16|DEM_SEX|CONCEPT_ISVALIDMEMBER|Birth sex is SNOMED-CT|Birth sex not coded as SNOMED-CT|Scoring|||SNO_INT_USEXT
17|DEM_ETHN|CONCEPT_ISVALIDMEMBER|Ethnicity is valid code|Ethnicity is invalid|Scoring|||CDC_RE
18|DEM_RACE|CONCEPT_ISVALIDMEMBER|Race is valid concept|Race is invalid|Scoring|||CDC_RE
19|IMM_ADMDT|ATTR_ISPASTDATE|Immunization date is valid|Immunization date is invalid|Scoring|||
20|IMM_VACC|CONCEPT_ISVALIDMEMBER|Immunization is valid concept|Immunization is not valid concept|Scoring|||FDA_PACK,CDC_CVX
21|IMM_LOTNO|ATTR_ISPOPULATED|Immunization Lot number is populated|Immunization Lot number not populated|Scoring|||
22|MED_DRUG|CONCEPT_ISVALIDMEMBER|Medication is Compatible|Medication is invalid |Scoring|||NLM_RXN,FDA_PACK
23|MED_STDT|ATTR_ISPASTDATE|Medication date is valid|Medication date is invalid|Scoring|||
24|MED_DOSEAMT|ATTR_ISNUMERIC|Medication dose is a valid number|Medication dose is invalid|Scoring|||
25|MED_DOSEAMTUOM|ATTR_INEXTERNALLIST|Medication dose unit is valid|Medication dose unit is invalid|Scoring|||UCUM
26|MED_IND|ATTR_ISPOPULATED|Medication indication is populated|Medication indication not populated|Scoring|||
27|MED_FSTAT|ATTR_ISPOPULATED|Medication fill status is populated|Medication fill status not populated|Scoring|||
28|PRC_PROC|CONCEPT_ISVALIDMEMBER|Procedure is valid concept|Procedure is invalid|Scoring|||SNO_INT_USEXT,AMA_CPT
29|PRC_PRCDT|ATTR_ISPASTDATE|Procedure date is valid|Procedure date is invalid|Scoring|||
30|PRC_RSN|ATTR_ISPOPULATED|Procedure reason is populated|Procedure reason not populated|Scoring|||
31|ENC_DATETIME|ATTR_ISPASTDATE|Encounter date is in the past|Encounter date is in not the past|Scoring|||
32|ENC_DIAGNOSIS|CONCEPT_ISVALIDMEMBER|Diagnosis is SNOMED-CT or ICD-10-CM|Diagnosis is not SNOMED-CT or ICD-10-CM|Scoring|||SNO_INT_USEXT,WHO_ICD10CM_FULL
33|ENC_TYPE|ATTR_ISPOPULATED|Encounter type is populated|Encounter type is not populated|Scoring|||
34|ENC_DISPOSITION|ATTR_ISPOPULATED|Encounter disposition is populated|Encounter disposition is not populated|Scoring|||
35|ENC_LOCATION|ATTR_ISPOPULATED|Encounter location is populated|Encounter location is not populated|Scoring|||
36|VIT_VITAL|CONCEPT_ISVALIDMEMBER|Vital sign is valid concept|Vital sign is invalid|Scoring|||REGEN_LOINC
37|VIT_RESUNIT|ATTR_INEXTERNALLIST|Vital sign result unit is UCUM|Vital sign result unit is not UCUM|Scoring||ATTR_ISPOPULATED|UCUM
38|IMAGING_PROCEDURE|CONCEPT_ISVALIDMEMBER|Imaging Procedure is LOINC|Imaging Procedure is not LOINC|Scoring|||REGEN_LOINC
39|IMAGING_RPT_DATETIME|ATTR_ISPASTDATE|report date is valid|report date is invalid|Scoring|||
42|DOC_TYPE|CONCEPT_ISVALIDMEMBER|Document type is LOINC|Document type is not LOINC|Scoring|||REGEN_LOINC
43|DOC_EFFDATE|ATTR_ISPASTDATE|Document date is past date|Document date is not past date|Scoring|||
44|HA_ITEM|CONCEPT_ISVALIDMEMBER|Health status assessment is  LOINC or SNOMED-CT|Health status assessment is  not LOINC or SNOMED-CT|Scoring|||REGEN_LOINC,SNO_INT_USEXT
45|HA_EFFDT|ATTR_ISPASTDATE|Health Status assessment date is date in past|Health Status assessment date is not date in past|Scoring|||
46|GOAL_GOAL|ATTR_ISPOPULATED|goal is populated|goal is not populated|Scoring|||
47|GOAL_EFFDATE|ATTR_ISDATE|Goal date is valid|Goal date is invalid|Scoring|||
48|IMAGING_RPT_HASATTACHMENT|ATTRIBUTE_INDICATOR_IS_TRUE|Image has attachment|Image is missing attachment|Scoring|||
48|DOC_HAS_ATTACHMENT|ATTRIBUTE_INDICATOR_IS_TRUE|Document has attachment|Document does not have attachment|Scoring|||
49|LAB_TEST|CONCEPT_HASDISPLAY|Lab result has test name|Lab result does not have test name|Scoring|||
50|LAB_PERFSITE|ATTR_ISPOPULATED|Peforming Site is populated|Peforming Site is not populated|Scoring|||
51|LAB_RESVALUE|ATTR_ISNUMERIC|Result Value is quant|Result Value is qual|Scoring||ATTR_ISPOPULATED|
52|LAB_REFRNG|RANGEVALUE_ISCOMPLETE|Ref Range has H and L|Ref Range missing H and/or L|Scoring||ATTR_ISPOPULATED|
53|LAB_SPECTYPE|ATTR_ISPOPULATED|Specimen Type is populated|Specimen Type is NOT populated|Scoring|||
55|LAB_ABFLAG|ATTR_INEXTERNALLIST|Abnormal Flag adheres to standard.|Abnormal Flag doesn't adhere to standard.|Scoring||ATTR_ISPOPULATED|AbFlag
"""

CLINICAL_MODEL_MNEMONIC = "PAT_CLINICAL_V1"

# Rubric mnemonic, name, rows.
RUBRICS = (
    ("USCDI_V3", "USCDI v3", CORE_DATA_V3),
    ("USCDI_V2", "USCDI v2", CORE_DATA_V2),
    ("Basic_VA_Lab", "Basic VA Lab", LAB),
)

# Code systems the rubrics name, with their public identifiers.
#   mnemonic|name|URI|identifiers
CODE_SYSTEMS = """
REGEN_LOINC|LOINC|http://loinc.org|2.16.840.1.113883.6.1,urn:oid:2.16.840.1.113883.6.1
SNO_INT_USEXT|SNOMED-CT|http://snomed.info/sct|2.16.840.1.113883.6.96,urn:oid:2.16.840.1.113883.6.96
NLM_RXN|RxNorm|http://www.nlm.nih.gov/research/umls/rxnorm|2.16.840.1.113883.6.88,urn:oid:2.16.840.1.113883.6.88
WHO_ICD10CM_FULL|ICD-10-CM|http://hl7.org/fhir/sid/icd-10-cm|2.16.840.1.113883.6.90,urn:oid:2.16.840.1.113883.6.90
WHO_ICD10PCS_FULL|ICD-10-PCS|http://www.cms.gov/Medicare/Coding/ICD10|2.16.840.1.113883.6.4,urn:oid:2.16.840.1.113883.6.4
CDC_RE|CDC Race and Ethnicity||2.16.840.1.113883.6.238,urn:oid:2.16.840.1.113883.6.238
FDA_PACK|NDC|http://hl7.org/fhir/sid/ndc|2.16.840.1.113883.6.69,urn:oid:2.16.840.1.113883.6.69
CDC_CVX|CVX|http://hl7.org/fhir/sid/cvx|2.16.840.1.113883.12.292,urn:oid:2.16.840.1.113883.12.292
AMA_CPT|CPT|http://www.ama-assn.org/go/cpt|2.16.840.1.113883.6.12,urn:oid:2.16.840.1.113883.6.12
HL7_ADMINGNDR|Administrative Gender|http://hl7.org/fhir/administrative-gender|2.16.840.1.113883.5.1,urn:oid:2.16.840.1.113883.5.1
"""
