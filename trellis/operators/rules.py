"""Fixed tables of the merge: predicates and entity types to the native vocabulary of the base graph."""

from __future__ import annotations

# Native relations and entity types of the base graph.
NATIVE_RELATIONS = (
    "anatomy_anatomy", "anatomy_protein_absent", "anatomy_protein_present", "bioprocess_bioprocess", "bioprocess_protein", "cellcomp_cellcomp", "cellcomp_protein", "contraindication", "disease_disease",
    "disease_phenotype_negative", "disease_phenotype_positive", "disease_protein", "drug_drug", "drug_effect", "drug_protein", "exposure_bioprocess", "exposure_cellcomp", "exposure_disease", "exposure_exposure",
    "exposure_molfunc", "exposure_protein", "indication", "molfunc_molfunc", "molfunc_protein", "off-label use", "pathway_pathway", "pathway_protein", "phenotype_phenotype", "phenotype_protein", "protein_protein",
)
NATIVE_TYPES = ("gene/protein", "disease", "drug", "effect/phenotype", "biological_process", "cellular_component", "molecular_function", "pathway", "anatomy", "exposure")

# Predicates with one relation whatever the types are: predicate, relation, display relation.
CONSTANT_RULES = (
    ("treats", "indication", "indication"),
    ("diagnoses", "ext_diagnoses", "diagnoses"),
    ("has-symptom", "disease_phenotype_positive", "phenotype present"),
    ("contraindicated-for", "contraindication", "contraindication"),
    ("biomarker-of", "ext_biomarker_of", "biomarker of"),
)

# Relation and display relation of predicates that depend on the types, where no type pair fits.
DEFAULT_RULES = (
    ("causes", "ext_causes", "causes"),
    ("associated-with", "ext_associated_with", "associated with"),
    ("expressed-in", "ext_expressed_in", "expressed in"),
    ("located-in", "ext_located_in", "located in"),
    ("part-of", "ext_part_of", "part of"),
    ("subtype-of", "ext_subtype_of", "subtype of"),
    ("interacts-with", "ext_interacts_with", "interacts with"),
    ("inhibits", "ext_inhibits", "inhibits"),
    ("activates", "ext_activates", "activates"),
    ("used-for", "ext_used_for", "used for"),
    ("agonism-or-antagonism", "ext_agonism_or_antagonism", "agonism or antagonism"),
    ("binding", "ext_binding", "binding"),
    ("affects-expression", "ext_affects_expression", "affects expression"),
    ("metabolizes", "ext_metabolizes", "metabolizes"),
    ("transports", "ext_transports", "transports"),
    ("enzyme-activity", "ext_enzyme_activity", "enzyme activity"),
    ("side-effect", "ext_side_effect", "side effect"),
    ("contributes-to-pathogenesis", "ext_contributes_to_pathogenesis", "contributes to pathogenesis"),
    ("mutation-affects-disease", "ext_mutation_affects_disease", "affects disease risk"),
    ("gene-regulates-gene", "ext_gene_regulates_gene", "regulates"),
)

# Predicates read in either direction.
SYMMETRIC_PREDICATES = ("associated-with", "interacts-with")

# Type pairs of the predicates above: predicate, type of x, type of y, relation, display relation.
PAIR_RULES = (
    ("causes", "drug", "effect/phenotype", "drug_effect", "side effect"),
    ("causes", "drug", "disease", "drug_effect", "side effect"),
    ("causes", "exposure", "disease", "exposure_disease", "linked to"),
    ("causes", "exposure", "biological_process", "exposure_bioprocess", "associated with"),
    ("causes", "exposure", "cellular_component", "exposure_cellcomp", "associated with"),
    ("causes", "exposure", "molecular_function", "exposure_molfunc", "associated with"),
    ("causes", "exposure", "gene/protein", "exposure_protein", "associated with"),
    ("causes", "disease", "effect/phenotype", "disease_phenotype_positive", "phenotype present"),
    ("associated-with", "disease", "disease", "disease_disease", "associated with"),
    ("associated-with", "disease", "effect/phenotype", "disease_phenotype_positive", "phenotype present"),
    ("associated-with", "disease", "gene/protein", "disease_protein", "associated with"),
    ("associated-with", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("associated-with", "drug", "drug", "drug_drug", "synergistic interaction"),
    ("associated-with", "drug", "gene/protein", "drug_protein", "target"),
    ("associated-with", "exposure", "disease", "exposure_disease", "linked to"),
    ("associated-with", "exposure", "gene/protein", "exposure_protein", "associated with"),
    ("associated-with", "exposure", "biological_process", "exposure_bioprocess", "associated with"),
    ("associated-with", "exposure", "cellular_component", "exposure_cellcomp", "associated with"),
    ("associated-with", "exposure", "molecular_function", "exposure_molfunc", "associated with"),
    ("associated-with", "pathway", "gene/protein", "pathway_protein", "associated with"),
    ("associated-with", "biological_process", "gene/protein", "bioprocess_protein", "associated with"),
    ("associated-with", "cellular_component", "gene/protein", "cellcomp_protein", "associated with"),
    ("associated-with", "molecular_function", "gene/protein", "molfunc_protein", "associated with"),
    ("associated-with", "effect/phenotype", "effect/phenotype", "phenotype_phenotype", "associated with"),
    ("associated-with", "effect/phenotype", "gene/protein", "phenotype_protein", "associated with"),
    ("expressed-in", "gene/protein", "anatomy", "anatomy_protein_present", "expression present"),
    ("located-in", "gene/protein", "anatomy", "anatomy_protein_present", "expression present"),
    ("located-in", "anatomy", "anatomy", "anatomy_anatomy", "parent-child"),
    ("part-of", "anatomy", "anatomy", "anatomy_anatomy", "parent-child"),
    ("part-of", "disease", "disease", "disease_disease", "parent-child"),
    ("part-of", "biological_process", "biological_process", "bioprocess_bioprocess", "parent-child"),
    ("part-of", "pathway", "pathway", "pathway_pathway", "parent-child"),
    ("part-of", "cellular_component", "cellular_component", "cellcomp_cellcomp", "parent-child"),
    ("part-of", "molecular_function", "molecular_function", "molfunc_molfunc", "parent-child"),
    ("part-of", "effect/phenotype", "effect/phenotype", "phenotype_phenotype", "parent-child"),
    ("subtype-of", "disease", "disease", "disease_disease", "parent-child"),
    ("subtype-of", "anatomy", "anatomy", "anatomy_anatomy", "parent-child"),
    ("subtype-of", "biological_process", "biological_process", "bioprocess_bioprocess", "parent-child"),
    ("subtype-of", "pathway", "pathway", "pathway_pathway", "parent-child"),
    ("subtype-of", "cellular_component", "cellular_component", "cellcomp_cellcomp", "parent-child"),
    ("subtype-of", "molecular_function", "molecular_function", "molfunc_molfunc", "parent-child"),
    ("subtype-of", "effect/phenotype", "effect/phenotype", "phenotype_phenotype", "parent-child"),
    ("interacts-with", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("interacts-with", "drug", "drug", "drug_drug", "synergistic interaction"),
    ("interacts-with", "drug", "gene/protein", "drug_protein", "target"),
    ("inhibits", "drug", "gene/protein", "drug_protein", "target"),
    ("inhibits", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("inhibits", "pathway", "gene/protein", "pathway_protein", "associated with"),
    ("inhibits", "biological_process", "gene/protein", "bioprocess_protein", "associated with"),
    ("inhibits", "molecular_function", "gene/protein", "molfunc_protein", "associated with"),
    ("activates", "drug", "gene/protein", "drug_protein", "target"),
    ("activates", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("activates", "pathway", "gene/protein", "pathway_protein", "associated with"),
    ("activates", "biological_process", "gene/protein", "bioprocess_protein", "associated with"),
    ("activates", "molecular_function", "gene/protein", "molfunc_protein", "associated with"),
    ("used-for", "drug", "disease", "indication", "indication"),
    ("agonism-or-antagonism", "drug", "gene/protein", "drug_protein", "target"),
    ("agonism-or-antagonism", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("binding", "drug", "gene/protein", "drug_protein", "target"),
    ("binding", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("binding", "drug", "drug", "drug_drug", "synergistic interaction"),
    ("affects-expression", "drug", "gene/protein", "drug_protein", "target"),
    ("affects-expression", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("affects-expression", "pathway", "gene/protein", "pathway_protein", "associated with"),
    ("affects-expression", "biological_process", "gene/protein", "bioprocess_protein", "associated with"),
    ("affects-expression", "molecular_function", "gene/protein", "molfunc_protein", "associated with"),
    ("metabolizes", "gene/protein", "drug", "drug_protein", "target"),
    ("metabolizes", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("transports", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("enzyme-activity", "drug", "gene/protein", "drug_protein", "target"),
    ("enzyme-activity", "gene/protein", "gene/protein", "protein_protein", "ppi"),
    ("side-effect", "drug", "effect/phenotype", "drug_effect", "side effect"),
    ("side-effect", "drug", "disease", "drug_effect", "side effect"),
    ("contributes-to-pathogenesis", "pathway", "disease", "disease_disease", "associated with"),
    ("contributes-to-pathogenesis", "biological_process", "disease", "disease_disease", "associated with"),
    ("contributes-to-pathogenesis", "gene/protein", "disease", "disease_protein", "associated with"),
    ("mutation-affects-disease", "gene/protein", "disease", "disease_protein", "associated with"),
    ("gene-regulates-gene", "gene/protein", "gene/protein", "protein_protein", "ppi"),
)

# Relations that contradict each other for the same pair.
OPPOSITES = (("indication", "contraindication"), ("anatomy_protein_present", "anatomy_protein_absent"), ("disease_phenotype_positive", "disease_phenotype_negative"))

# Raw type names and the native type each stands for.
DIRECT_TYPES = {
    "gene": "gene/protein",
    "protein": "gene/protein",
    "gene/protein": "gene/protein",
    "enzyme": "gene/protein",
    "receptor": "gene/protein",
    "kinase": "gene/protein",
    "antibody": "gene/protein",
    "peptide": "gene/protein",
    "hormone": "gene/protein",
    "transcription factor": "gene/protein",
    "biomarker": "gene/protein",
    "genetic variant": "gene/protein",
    "mutation": "gene/protein",
    "disease": "disease",
    "disorder": "disease",
    "syndrome": "disease",
    "infection": "disease",
    "cancer": "disease",
    "tumor": "disease",
    "condition": "disease",
    "pathology": "disease",
    "injury": "disease",
    "drug": "drug",
    "medication": "drug",
    "pharmaceutical": "drug",
    "compound": "drug",
    "inhibitor": "drug",
    "therapy": "drug",
    "treatment": "drug",
    "medical device": "drug",
    "device": "drug",
    "anticoagulant": "drug",
    "vaccine": "drug",
    "supplement": "drug",
    "phenotype": "effect/phenotype",
    "symptom": "effect/phenotype",
    "sign": "effect/phenotype",
    "side effect": "effect/phenotype",
    "adverse effect": "effect/phenotype",
    "clinical feature": "effect/phenotype",
    "effect/phenotype": "effect/phenotype",
    "anatomy": "anatomy",
    "organ": "anatomy",
    "tissue": "anatomy",
    "cell type": "anatomy",
    "anatomical structure": "anatomy",
    "body part": "anatomy",
    "anatomical location": "anatomy",
    "biological_process": "biological_process",
    "biological process": "biological_process",
    "process": "biological_process",
    "pathway": "pathway",
    "signaling pathway": "pathway",
    "metabolic pathway": "pathway",
    "cellular_component": "cellular_component",
    "cellular component": "cellular_component",
    "organelle": "cellular_component",
    "membrane": "cellular_component",
    "molecular_function": "molecular_function",
    "molecular function": "molecular_function",
    "function": "molecular_function",
    "exposure": "exposure",
    "toxin": "exposure",
    "chemical": "exposure",
    "pollutant": "exposure",
    "environmental factor": "exposure",
}

# Parts of a name that stand for a native type, the first group that occurs wins.
TYPE_KEYWORDS = (
    ("gene/protein", ("gene", "protein", "enzyme", "receptor", "kinase", "channel", "transporter protein", "antibody", "peptide", "hormone", "transcription", "biomarker", "variant", "mutation", "psa", "egfr", "brca", "her2")),
    ("disease", ("disease", "disorder", "syndrome", "infection", "cancer", "tumor", "carcinoma", "sarcoma", "lymphoma", "leukemia", "insufficiency", "failure", "thrombosis", "embolism", "injury", "patholog", "lesion", "malignancy")),
    ("drug", ("drug", "medication", "pharmaceutical", "compound", "inhibitor", "agonist", "antagonist", "anticoagulant", "antiplatelet", "antibiotic", "vaccine", "therapy", "treatment", "medical device", "filter", "catheter", "implant", "supplement", "capsule", "tablet", "injection")),
    ("effect/phenotype", ("symptom", "sign", "phenotype", "side effect", "adverse", "clinical feature", "manifestation", "presentation", "pain", "swelling", "fever", "edema", "strain", "nausea", "fatigue", "dyspnea", "tachycardia")),
    ("anatomy", ("anatomy", "organ", "tissue", "vein", "artery", "heart", "lung", "liver", "kidney", "extremit", "vena cava", "vessel", "muscle", "bone", "brain", "nerve", "cell type", "anatomical", "body part", "region", "pancreatic", "alveolus", "colon", "stomach")),
    ("biological_process", ("biological process", "process", "coagulation", "thrombogenesis", "fibrinolysis", "apoptosis", "proliferation", "inflammation", "metabolism", "regulation", "signaling", "immune response", "prevention", "pathogenesis", "mechanism")),
    ("pathway", ("pathway", "signaling pathway", "metabolic pathway", "wnt pathway", "mapk", "pi3k")),
    ("cellular_component", ("cell", "membrane", "nucleus", "mitochondria", "ribosome", "cytoplasm", "organelle", "cellular component")),
    ("molecular_function", ("molecular function", "binding", "catalysis", "enzymatic activity", "transport activity")),
    ("exposure", ("exposure", "toxin", "chemical", "pollutant", "radiation", "environmental", "stressor")),
)

# Names of entity types and the one each is counted under; a type that is not listed stays. Blanks are underscores before the lookup, so keys with a blank never match.
TYPE_NAMES = {
    "gene": "gene/protein", "protein": "gene/protein", "gene_protein": "gene/protein", "gene/protein": "gene/protein",
    "effect": "effect/phenotype", "phenotype": "effect/phenotype", "effect_phenotype": "effect/phenotype", "effect/phenotype": "effect/phenotype",
    "biological_process": "biological_process", "molecular_function": "molecular_function", "cellular_component": "cellular_component",
}
# The same for the type-pair matrix, with what says nothing as none.
TYPE_NAMES_WIDE = {
    "gene": "gene/protein", "protein": "gene/protein", "gene_protein": "gene/protein", "genes/proteins": "gene/protein", "gene/proteins": "gene/protein", "genes": "gene/protein", "proteins": "gene/protein",
    "phenotype": "effect/phenotype", "phenotypes": "effect/phenotype", "effect": "effect/phenotype", "effects": "effect/phenotype", "effect_phenotype": "effect/phenotype", "effect/phenotypes": "effect/phenotype",
    "biological process": "biological_process", "biological_processes": "biological_process", "bp": "biological_process",
    "molecular function": "molecular_function", "molecular_functions": "molecular_function", "mf": "molecular_function",
    "cellular component": "cellular_component", "cellular_components": "cellular_component", "cc": "cellular_component",
    "diseases": "disease", "anatomical_entity": "anatomy", "anatomical_structure": "anatomy",
    "chemical": "drug", "compound": "drug", "drug/compound": "drug", "drugs": "drug",
    "environmental_exposure": "exposure", "environment": "exposure", "medical_procedure": "procedure", "procedures": "procedure",
    "": "none", "na": "none", "nan": "none", "null": "none", "unknown": "none", "other": "none",
}
# Display relations that are shown apart, in their order; the others are Other.
SHOWN_RELATIONS = ("associated with", "used for", "part of", "phenotype present", "parent-child", "indication", "causes", "affects expression", "located in", "expressed in")
