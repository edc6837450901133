"""Hand-written signatures of licenses and notices.

A signature is (priority, keyword, pattern). The pattern is a regular expression over
lower-cased text in which ``_`` stands for whatever separates two words; a text without
the keyword is not searched for it. Priorities: 90 texts and addresses that only one
license has, 80 notices, 70 names with a version, 60 names that say license, 50 short
names, 40 wording that several licenses share, 30 hints.
"""

UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided|covered)_under_(?:the_)?(?:terms_of_(?:the_)?)?"

SIGNATURES: dict[str, list[tuple[int, str, str]]] = {
    "mit": [
        (90, "hereby", "permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy_of_this_software_and_associated"),
        (90, "opensource", "opensource_org_licenses_mit"),
        (85, "merchantability", "the_software_is_provided_as_is_without_warranty_of_any_kind_express_or_implied_including_but_not_limited_to_the_warranties_of_merchantability"),
        (85, "portions", "the_above_copyright_notice_and_this_permission_notice_shall_be_included_in_all_copies_or_substantial_portions"),
        (80, "mit", UNDER + "mit(?:_licen[cs]e)?"),
        (80, "expat", UNDER + "expat(?:_licen[cs]e)?"),
        (70, "mit", "the_mit_licen[cs]e_mit"),
        (60, "mit", "mit_licen[cs]ed?"),
        (60, "mit", "licen[cs]e_(?:is_)?(?:the_)?mit"),
        (60, "expat", "expat_licen[cs]e"),
        (55, "x11", "(?:mit_)?x11_licen[cs]e"),
        (50, "mit", "mit_style(?:_licen[cs]e)?"),
    ],
    "mit-0": [
        (85, "mit", "mit_no_attribution"),
        (70, "mit", "mit_0_licen[cs]e"),
    ],
    "apache-2": [
        (90, "apache", "www_apache_org_licenses_license_2_0"),
        (90, "apache", "apache_license_version_2_0_january_2004"),
        (85, "applicable", "unless_required_by_applicable_law_or_agreed_to_in_writing_software_distributed_under_the_license"),
        (85, "compliance", "you_may_not_use_this_file_except_in_compliance_with_the_license"),
        (80, "apache", UNDER + "apache_(?:software_)?licen[cs]e_(?:version_|v)?2(?:_0)?"),
        (80, "apache", UNDER + "apache_(?:version_|v)?2(?:_0)?(?:_licen[cs]e)?"),
        (70, "apache", "apache_(?:software_)?licen[cs]e_(?:version_|v)?2(?:_0)?"),
        (70, "apache", "apache_(?:version_|v)?2(?:_0)?_licen[cs]e"),
        (65, "asl", "asl_(?:version_|v)?2(?:_0)?"),
        (60, "apache", "licen[cs]e_apache_2(?:_0)?"),
        (50, "apache", "apache_2_0"),
    ],
    "apache-1.1": [
        (85, "apache", "the_apache_software_license_version_1_1"),
        (70, "apache", "apache_(?:software_)?licen[cs]e_(?:version_|v)?1_1"),
        (85, "apache", "this_product_includes_software_developed_by_the_apache_software_foundation"),
    ],
    "apache-1": [(70, "apache", "apache_(?:software_)?licen[cs]e_(?:version_|v)?1_0")],
    "apache": [
        (60, "apache", "apache_(?:software_)?licen[cs]e"),
        (55, "apache", "licen[cs]e_apache"),
    ],
    "bsd-2-clause": [
        (80, "bsd", UNDER + "(?:simplified|freebsd|2_clause|two_clause)_bsd(?:_licen[cs]e)?"),
        (70, "clause", "bsd_(?:2|two)_clause(?:_licen[cs]e)?"),
        (70, "clause", "(?:2|two)_clause_bsd(?:_licen[cs]e)?"),
        (65, "simplified", "simplified_bsd(?:_licen[cs]e)?"),
        (60, "freebsd", "freebsd_licen[cs]e"),
        (90, "opensource", "opensource_org_licenses_bsd_2_clause"),
    ],
    "bsd-3-clause": [
        (90, "endorse", "neither_the_name_of_.{1,120}?_may_be_used_to_endorse_or_promote_products_derived_from_this_software"),
        (80, "bsd", UNDER + "(?:new|modified|revised|3_clause|three_clause)_bsd(?:_licen[cs]e)?"),
        (70, "clause", "bsd_(?:3|three)_clause(?:_licen[cs]e)?"),
        (70, "clause", "(?:3|three)_clause_bsd(?:_licen[cs]e)?"),
        (65, "bsd", "(?:new|modified|revised)_bsd_licen[cs]e"),
        (90, "opensource", "opensource_org_licenses_bsd_3_clause"),
        (85, "endorse", "the_names?_of_the_authors?_may_not_be_used_to_endorse_or_promote_products"),
    ],
    "bsd-4-clause": [
        (90, "advertising", "all_advertising_materials_mentioning_features_or_use_of_this_software_must_display"),
        (70, "clause", "bsd_(?:4|four)_clause(?:_licen[cs]e)?"),
        (70, "clause", "(?:4|four)_clause_bsd(?:_licen[cs]e)?"),
        (65, "original", "original_bsd_licen[cs]e"),
    ],
    "bsd": [
        (80, "redistribution", "redistribution_and_use_in_source_and_binary_forms_with_or_without_modification"),
        (75, "redistributions", "redistributions_of_source_code_must_retain_the_above_copyright"),
        (75, "redistributions", "redistributions_in_binary_form_must_reproduce_the_above_copyright"),
        (70, "bsd", UNDER + "bsd(?:_style)?(?:_licen[cs]e)?"),
        (55, "bsd", "bsd_licen[cs]ed?"),
        (50, "bsd", "bsd_style(?:_licen[cs]e)?"),
        (50, "bsd", "licen[cs]e_bsd"),
        (50, "berkeley", "berkeley_software_distribution"),
    ],
    "0bsd": [
        (70, "zero", "zero_clause_bsd(?:_licen[cs]e)?"),
        (65, "0bsd", "0bsd"),
        (70, "bsd", "bsd_zero_clause(?:_licen[cs]e)?"),
    ],
    "isc": [
        (90, "disclaims", "the_software_is_provided_as_is_and_the_author_disclaims_all_warranties_with_regard_to_this_software"),
        (85, "permission", "permission_to_use_copy_modify_and_(?:or_)?distribute_this_software_for_any_purpose_with_or_without_fee"),
        (80, "isc", UNDER + "isc(?:_licen[cs]e)?"),
        (60, "isc", "isc_licen[cs]ed?"),
        (55, "isc", "licen[cs]e_isc"),
        (70, "consortium", "internet_(?:software|systems)_consortium_licen[cs]e"),
    ],
    "zlib": [
        (90, "misrepresented", "the_origin_of_this_software_must_not_be_misrepresented"),
        (85, "altered", "altered_source_versions_must_be_plainly_marked_as_such"),
        (70, "zlib", "zlib_libpng_licen[cs]e"),
        (60, "zlib", "zlib_licen[cs]e"),
        (75, "zlib", UNDER + "zlib(?:_licen[cs]e)?"),
    ],
    "libpng": [(65, "libpng", "libpng_licen[cs]e(?:_version_2)?")],
    "boost-1": [
        (90, "boost", "www_boost_org_license_1_0"),
        (85, "boost", "boost_software_license_version_1_0"),
        (80, "boost", UNDER + "boost_software_licen[cs]e"),
        (60, "boost", "boost_(?:software_)?licen[cs]e"),
        (55, "bsl", "bsl_1_0"),
    ],
    "busl-1.1": [
        (85, "business", "business_source_licen[cs]e_1_1"),
        (65, "business", "business_source_licen[cs]e"),
        (60, "busl", "busl_1_1"),
    ],
    "gpl-1": [
        (70, "gnu", "gnu_general_public_licen[cs]e_(?:version_|v)1(?:_0)?"),
        (65, "gplv1", "gplv1"),
        (60, "gpl", "gpl_(?:version_|v)?1(?:_0)?"),
    ],
    "gpl-2": [
        (90, "1991", "gnu_general_public_license_version_2_june_1991"),
        (85, "version", "either_version_2_of_the_license_or_at_your_option_any_later_version"),
        (80, "gnu", UNDER + "gnu_(?:gpl|general_public_licen[cs]e)_(?:version_|v)?2(?:_0)?"),
        (80, "gpl", UNDER + "gpl_?(?:version_|v)?2(?:_0)?"),
        (75, "gnu", "gnu_general_public_licen[cs]e_(?:as_published_by_the_free_software_foundation_)?(?:version_|v)2(?:_0)?"),
        (70, "gnu", "gnu_gpl_?(?:version_|v)?2(?:_0)?"),
        (65, "gplv2", "gplv2"),
        (60, "gpl", "gpl_(?:version_|v)?2(?:_0)?(?:_only|_or_later)?"),
        (60, "gpl2", "gpl2"),
        (80, "version", "under_the_terms_of_version_2_of_the_gnu_general_public_licen[cs]e"),
    ],
    "gpl-3": [
        (90, "2007", "gnu_general_public_license_version_3_29_june_2007"),
        (85, "version", "either_version_3_of_the_license_or_at_your_option_any_later_version"),
        (80, "gnu", UNDER + "gnu_(?:gpl|general_public_licen[cs]e)_(?:version_|v)?3(?:_0)?"),
        (80, "gpl", UNDER + "gpl_?(?:version_|v)?3(?:_0)?"),
        (75, "gnu", "gnu_general_public_licen[cs]e_(?:as_published_by_the_free_software_foundation_)?(?:version_|v)3(?:_0)?"),
        (70, "gnu", "gnu_gpl_?(?:version_|v)?3(?:_0)?"),
        (65, "gplv3", "gplv3"),
        (60, "gpl", "gpl_(?:version_|v)?3(?:_0)?(?:_only|_or_later)?"),
        (60, "gpl3", "gpl3"),
        (90, "gnu", "www_gnu_org_licenses_gpl_3_0"),
    ],
    "gpl": [
        (80, "redistribute", "this_program_is_free_software_you_can_redistribute_it_and_or_modify_it_under_the_terms_of_the_gnu_general_public"),
        (75, "gnu", "you_should_have_received_a_copy_of_the_gnu_general_public_licen[cs]e"),
        (75, "gnu", "www_gnu_org_licenses_gpl"),
        (60, "gnu", "gnu_general_public_licen[cs]e"),
        (60, "gnu", "gnu_gpl"),
        (55, "gpl", "gpl_licen[cs]ed?"),
        (55, "gpl", UNDER + "gpl"),
        (50, "gpl", "licen[cs]e_gpl"),
    ],
    "gpl-exception": [
        (85, "exception", "gpl_(?:version_|v)?[23](?:_0)?_with_(?:the_)?(?:classpath|linking|runtime_library|gcc|openssl|font)_exception"),
        (70, "classpath", "classpath_exception"),
        (75, "exception", "as_a_special_exception_the_copyright_holders?"),
        (65, "gcc", "gcc_runtime_library_exception"),
    ],
    "lgpl-2": [
        (85, "1991", "gnu_library_general_public_license_version_2_june_1991"),
        (70, "gnu", "gnu_(?:library|lesser)_general_public_licen[cs]e_(?:version_|v)?2(?:_0)?"),
        (60, "lgpl", "lgpl_?(?:version_|v)?2(?:_0)?"),
    ],
    "lgpl-2.1": [
        (90, "1999", "gnu_lesser_general_public_license_version_2_1_february_1999"),
        (85, "version", "either_version_2_1_of_the_license_or_at_your_option_any_later_version"),
        (80, "gnu", UNDER + "gnu_lesser_general_public_licen[cs]e_(?:version_|v)?2_1"),
        (75, "gnu", "gnu_lesser_general_public_licen[cs]e_(?:version_|v)?2_1"),
        (70, "lgpl", "lgpl_?(?:version_|v)?2_1(?:_only|_or_later)?"),
    ],
    "lgpl-3": [
        (85, "gnu", "gnu_lesser_general_public_license_version_3_29_june_2007"),
        (75, "gnu", "gnu_lesser_general_public_licen[cs]e_(?:version_|v)?3(?:_0)?"),
        (70, "lgpl", "lgpl_?(?:version_|v)?3(?:_0)?(?:_only|_or_later)?"),
        (85, "gnu", "www_gnu_org_licenses_lgpl_3_0"),
    ],
    "lgpl": [
        (80, "library", "this_library_is_free_software_you_can_redistribute_it_and_or_modify"),
        (75, "gnu", "you_should_have_received_a_copy_of_the_gnu_lesser_general_public_licen[cs]e"),
        (75, "gnu", "www_gnu_org_licenses_lgpl"),
        (60, "gnu", "gnu_lesser_general_public_licen[cs]e"),
        (60, "gnu", "gnu_library_general_public_licen[cs]e"),
        (60, "gnu", "gnu_lgpl"),
        (55, "lgpl", "lgpl_licen[cs]ed?"),
        (55, "lgpl", UNDER + "lgpl"),
        (50, "lgpl", "licen[cs]e_lgpl"),
    ],
    "agpl-3": [
        (90, "affero", "gnu_affero_general_public_license_version_3_19_november_2007"),
        (80, "affero", UNDER + "gnu_affero_general_public_licen[cs]e_(?:version_|v)?3(?:_0)?"),
        (75, "affero", "gnu_affero_general_public_licen[cs]e_(?:version_|v)?3(?:_0)?"),
        (70, "agpl", "agpl_?(?:version_|v)?3(?:_0)?(?:_only|_or_later)?"),
        (85, "gnu", "www_gnu_org_licenses_agpl_3_0"),
    ],
    "agpl": [
        (60, "affero", "(?:gnu_)?affero_general_public_licen[cs]e"),
        (75, "affero", "you_should_have_received_a_copy_of_the_gnu_affero_general_public_licen[cs]e"),
        (55, "agpl", "agpl_licen[cs]ed?"),
        (55, "agpl", UNDER + "agpl"),
    ],
    "gfdl": [
        (85, "document", "permission_is_granted_to_copy_distribute_and_or_modify_this_document_under_the_terms_of_the_gnu_free_documentation"),
        (70, "gnu", "gnu_free_documentation_licen[cs]e_(?:version_|v)?1_[123]"),
        (60, "gnu", "gnu_free_documentation_licen[cs]e"),
        (55, "gfdl", "gfdl"),
    ],
    "mpl-1.1": [
        (85, "mozilla", "the_contents_of_this_file_are_subject_to_the_mozilla_public_license_version_1_1"),
        (70, "mozilla", "mozilla_public_licen[cs]e_(?:version_|v)?1_1"),
        (65, "mpl", "mpl_(?:version_|v)?1_1"),
        (85, "mozilla", "www_mozilla_org_mpl_mpl_1_1"),
    ],
    "mpl-2": [
        (90, "mozilla", "this_source_code_form_is_subject_to_the_terms_of_the_mozilla_public_license_v_2_0"),
        (90, "mozilla", "if_a_copy_of_the_mpl_was_not_distributed_with_this_file_you_can_obtain_one_at_.{0,12}mozilla_org_mpl_2_0"),
        (85, "mozilla", "mozilla_org_mpl_2_0"),
        (80, "mozilla", UNDER + "mozilla_public_licen[cs]e_(?:version_|v)?2(?:_0)?"),
        (70, "mozilla", "mozilla_public_licen[cs]e_(?:version_|v_?)?2(?:_0)?"),
        (65, "mpl", "mpl_?(?:version_|v)?2(?:_0)?"),
    ],
    "mpl": [
        (60, "mozilla", "mozilla_public_licen[cs]e"),
        (55, "mpl", "mpl_licen[cs]ed?"),
    ],
    "epl-1": [
        (85, "eclipse", "www_eclipse_org_legal_epl_v10"),
        (75, "eclipse", "eclipse_public_licen[cs]e_(?:version_|v)?1(?:_0)?"),
        (65, "epl", "epl_(?:version_|v)?1(?:_0)?"),
    ],
    "epl-2": [
        (85, "eclipse", "www_eclipse_org_legal_epl_(?:2_0|v20)"),
        (80, "eclipse", "made_available_under_the_terms_of_the_eclipse_public_licen[cs]e_2_0"),
        (75, "eclipse", "eclipse_public_licen[cs]e_(?:version_|v_?)?2(?:_0)?"),
        (65, "epl", "epl_(?:version_|v)?2(?:_0)?"),
    ],
    "epl": [(60, "eclipse", "eclipse_public_licen[cs]e"), (70, "eclipse", "eclipse_distribution_licen[cs]e")],
    "cpl-1": [(70, "common", "common_public_licen[cs]e(?:_(?:version_|v)?1(?:_0)?)?"), (60, "cpl", "cpl_1_0")],
    "cddl-1": [
        (85, "cddl", "common_development_and_distribution_licen[cs]e_cddl(?:_version_1_0)?"),
        (75, "distribution", "common_development_and_distribution_licen[cs]e"),
        (65, "cddl", "cddl_(?:version_|v)?1_[01]"),
        (55, "cddl", "cddl"),
    ],
    "eupl-1.1": [(75, "european", "european_union_public_licen[cs]e_(?:version_|v)?1_1"), (65, "eupl", "eupl_(?:version_|v)?1_1")],
    "eupl-1.2": [
        (85, "eupl", "licensed_under_the_eupl_version_1_2"),
        (75, "european", "european_union_public_licen[cs]e_(?:version_|v_?)?1_2"),
        (65, "eupl", "eupl_(?:version_|v)?1_2"),
    ],
    "eupl": [(60, "european", "european_union_public_licen[cs]e"), (55, "eupl", "eupl")],
    "artistic-1": [(70, "artistic", "artistic_licen[cs]e_(?:version_|v)?1(?:_0)?"), (75, "perl", "same_terms_as_perl_itself")],
    "artistic-2": [
        (85, "artistic", "the_artistic_license_2_0"),
        (75, "artistic", "artistic_licen[cs]e_(?:version_|v)?2(?:_0)?"),
        (65, "artistic", "artistic_2_0"),
    ],
    "artistic": [(55, "artistic", "artistic_licen[cs]e")],
    "unlicense": [
        (90, "unencumbered", "this_is_free_and_unencumbered_software_released_into_the_public_domain"),
        (85, "unlicense", "unlicense_org"),
        (60, "unlicense", "(?:the_)?unlicense"),
    ],
    "wtfpl": [
        (90, "public", "do_what_the_f(?:uck|\\*ck)_you_want_to_public_licen[cs]e"),
        (60, "wtfpl", "wtfpl"),
    ],
    "cc0-1": [
        (90, "creativecommons", "creativecommons_org_publicdomain_zero(?:_1_0)?"),
        (80, "cc0", "cc0_1_0_universal"),
        (70, "creative", "creative_commons_(?:zero|cc0)(?:_1_0)?"),
        (60, "cc0", "cc0(?:_1_0)?"),
        (75, "waived", "has_waived_all_copyright_and_related_or_neighboring_rights"),
    ],
    "cc-by-4": [
        (90, "creativecommons", "creativecommons_org_licenses_by_4_0"),
        (80, "creative", "creative_commons_attribution_4_0(?:_international)?(?:_public)?(?:_licen[cs]e)?"),
        (65, "cc", "cc_by_(?:version_|v)?4(?:_0)?"),
    ],
    "cc-by-3": [
        (90, "creativecommons", "creativecommons_org_licenses_by_3_0"),
        (80, "creative", "creative_commons_attribution_3_0(?:_unported)?(?:_licen[cs]e)?"),
        (65, "cc", "cc_by_(?:version_|v)?3(?:_0)?"),
    ],
    "cc-by-2": [
        (90, "creativecommons", "creativecommons_org_licenses_by_2_[05]"),
        (80, "creative", "creative_commons_attribution_2_[05](?:_generic)?(?:_licen[cs]e)?"),
    ],
    "cc-by": [
        (60, "creative", "creative_commons_attribution(?:_licen[cs]e)?"),
        (50, "cc", "cc_by"),
    ],
    "cc-by-sa": [
        (90, "creativecommons", "creativecommons_org_licenses_by_sa(?:_[1-4]_[05])?"),
        (80, "creative", "creative_commons_attribution_share_?alike(?:_[1-4]_[05])?(?:_international|_unported|_generic)?(?:_licen[cs]e)?"),
        (65, "cc", "cc_by_sa(?:_[1-4]_[05])?"),
    ],
    "cc-by-nd": [
        (90, "creativecommons", "creativecommons_org_licenses_by_nd(?:_[1-4]_[05])?"),
        (80, "creative", "creative_commons_attribution_no_?deriv(?:ative|s)?s?(?:_works)?(?:_[1-4]_[05])?"),
        (65, "cc", "cc_by_nd(?:_[1-4]_[05])?"),
    ],
    "cc-by-nc": [
        (90, "creativecommons", "creativecommons_org_licenses_by_nc(?:_[1-4]_[05])?"),
        (80, "creative", "creative_commons_attribution_non_?commercial(?:_[1-4]_[05])?(?:_international|_unported|_generic)?(?:_licen[cs]e)?"),
        (65, "cc", "cc_by_nc_[1-4]_[05]"),
    ],
    "cc-by-nc-sa": [
        (90, "creativecommons", "creativecommons_org_licenses_by_nc_sa(?:_[1-4]_[05])?"),
        (85, "creative", "creative_commons_attribution_non_?commercial_share_?alike(?:_[1-4]_[05])?"),
        (70, "cc", "cc_by_nc_sa(?:_[1-4]_[05])?"),
    ],
    "cc-by-nc-nd": [
        (90, "creativecommons", "creativecommons_org_licenses_by_nc_nd(?:_[1-4]_[05])?"),
        (85, "creative", "creative_commons_attribution_non_?commercial_no_?deriv(?:ative|s)?s?(?:_works)?(?:_[1-4]_[05])?"),
        (70, "cc", "cc_by_nc_nd(?:_[1-4]_[05])?"),
    ],
    "cc-sampling": [(70, "sampling", "creative_commons_sampling_plus")],
    "odbl": [
        (90, "opendatacommons", "opendatacommons_org_licenses_odbl"),
        (70, "database", "open_database_licen[cs]e"),
        (55, "odbl", "odbl(?:_1_0)?"),
    ],
    "odc-by": [
        (90, "opendatacommons", "opendatacommons_org_licenses_by"),
        (70, "open", "open_data_commons_attribution_licen[cs]e"),
        (60, "odc", "odc_by(?:_1_0)?"),
    ],
    "pddl": [
        (70, "open", "open_data_commons_public_domain_dedication"),
        (60, "pddl", "pddl(?:_1_0)?"),
    ],
    "cdla-permissive": [(70, "community", "community_data_licen[cs]e_agreement_permissive"), (60, "cdla", "cdla_permissive_[12]_0")],
    "cdla-sharing": [(70, "community", "community_data_licen[cs]e_agreement_sharing"), (60, "cdla", "cdla_sharing_1_0")],
    "ogl-uk": [
        (85, "contains", "contains_public_sector_information_licensed_under_the_open_government_licen[cs]e"),
        (60, "government", "open_government_licen[cs]e(?:_v(?:ersion_)?[123](?:_0)?)?"),
    ],
    "etalab-2": [(70, "etalab", "(?:licence_ouverte_)?etalab_2_0"), (60, "licence", "licence_ouverte")],
    "ofl-1.1": [
        (85, "scripts", "scripts_sil_org_ofl"),
        (80, "font", "this_font_software_is_licensed_under_the_sil_open_font_licen[cs]e"),
        (70, "sil", "sil_open_font_licen[cs]e(?:_(?:version_|v)?1_1)?"),
        (55, "ofl", "ofl_1_1"),
    ],
    "ubuntu-font": [(70, "ubuntu", "ubuntu_font_licen[cs]e(?:_version_1_0)?")],
    "bitstream-vera": [(75, "bitstream", "bitstream_vera_is_a_trademark_of_bitstream")],
    "python-2": [
        (85, "python", "psf_license_agreement_for_python"),
        (75, "python", "python_software_foundation_licen[cs]e(?:_version_2)?"),
        (60, "psf", "psf_licen[cs]e"),
        (55, "python", "python_licen[cs]e"),
    ],
    "ruby": [(65, "ruby", "ruby_licen[cs]e"), (75, "ruby", "same_terms_as_ruby(?:_itself)?")],
    "php-3": [
        (85, "php", "this_product_includes_php_software_freely_available_from"),
        (70, "php", "php_licen[cs]e_(?:version_|v)?3_0[01]?"),
        (55, "php", "php_licen[cs]e"),
    ],
    "perl": [(60, "perl", "perl_(?:5_)?licen[cs]e")],
    "tcl": [(60, "tcl", "tcl_tk_licen[cs]e")],
    "openssl": [
        (85, "openssl", "this_product_includes_software_developed_by_the_openssl_project"),
        (60, "openssl", "openssl_licen[cs]e"),
    ],
    "ssleay": [(80, "cryptographic", "this_product_includes_cryptographic_software_written_by")],
    "curl": [(60, "curl", "curl_licen[cs]e")],
    "icu": [(65, "icu", "icu_licen[cs]e"), (75, "unicode", "unicode_inc_license_agreement_data_files_and_software"), (60, "unicode", "unicode_licen[cs]e(?:_v3)?")],
    "postgresql": [(65, "postgresql", "(?:the_)?postgresql_licen[cs]e"), (85, "postgresql", "postgresql_database_management_system_formerly_known_as")],
    "sqlite-blessing": [(85, "evil", "may_you_do_good_and_not_evil"), (75, "forgiveness", "may_you_find_forgiveness_for_yourself_and_forgive_others")],
    "json": [(85, "evil", "the_software_shall_be_used_for_good_not_evil"), (55, "json", "json_licen[cs]e")],
    "beerware": [(85, "beer", "if_we_meet_some_day_and_you_think_this_stuff_is_worth_it_you_can_buy_me_a_beer"), (60, "beer", "beer_?ware_licen[cs]e")],
    "hippocratic": [(65, "hippocratic", "hippocratic_licen[cs]e(?:_[123]_[01])?")],
    "ms-pl": [(70, "microsoft", "microsoft_public_licen[cs]e(?:_ms_pl)?"), (55, "ms", "ms_pl")],
    "ms-rl": [(70, "microsoft", "microsoft_reciprocal_licen[cs]e"), (55, "ms", "ms_rl")],
    "ms-eula": [(65, "microsoft", "microsoft_software_licen[cs]e_terms")],
    "osl-3": [(75, "open", "open_software_licen[cs]e_(?:version_|v_?)?3(?:_0)?"), (60, "osl", "osl_3_0")],
    "afl-3": [(75, "academic", "academic_free_licen[cs]e_(?:version_|v_?)?3(?:_0)?"), (60, "afl", "afl_3_0")],
    "ncsa": [(75, "illinois", "university_of_illinois_(?:ncsa_)?open_source_licen[cs]e"), (60, "ncsa", "ncsa_open_source_licen[cs]e")],
    "w3c": [(75, "w3c", "w3c_software_(?:notice_and_)?(?:and_document_)?licen[cs]e")],
    "vim": [(60, "vim", "vim_licen[cs]e")],
    "ipl-1": [(70, "ibm", "ibm_public_licen[cs]e(?:_(?:version_|v)?1_0)?")],
    "npl": [(65, "netscape", "netscape_public_licen[cs]e")],
    "sspl-1": [(85, "server", "server_side_public_licen[cs]e(?:_(?:version_|v)?1)?"), (60, "sspl", "sspl(?:_1_0)?")],
    "elastic-2": [(75, "elastic", "elastic_licen[cs]e_(?:version_|v)?2(?:_0)?"), (60, "elastic", "elastic_licen[cs]e")],
    "commons-clause": [(75, "commons", "commons_clause_licen[cs]e_condition"), (60, "commons", "commons_clause")],
    "polyform": [(65, "polyform", "polyform_(?:noncommercial|small_business|shield|strict|perimeter)_licen[cs]e")],
    "prosperity": [(65, "prosperity", "prosperity_public_licen[cs]e")],
    "openrail": [(75, "rail", "(?:creativeml|bigscience)_open_?rail_m(?:_licen[cs]e)?"), (65, "responsible", "responsible_ai_licen[cs]e")],
    "llama-community": [(75, "llama", "llama_[234](?:_[0-9])?_community_licen[cs]e(?:_agreement)?")],
    "mulan-2": [(75, "mulan", "mulan_(?:psl|permissive_software_licen[cs]e)_(?:version_|v_?)?2")],
    "upl-1": [(70, "universal", "universal_permissive_licen[cs]e(?:_(?:version_|v_?)?1_0)?"), (55, "upl", "upl_1_0")],
    "bcl-sun": [(70, "sun", "sun_binary_code_licen[cs]e_agreement")],
    "oracle-otn": [(70, "oracle", "oracle_technology_network_licen[cs]e_agreement")],
    "cecill": [(75, "cecill", "cecill(?:_[bc])?(?:_(?:version_|v)?[12]_[01])?"), (70, "cea", "cea_cnrs_inria_logiciel_libre")],
    "qpl": [(65, "q", "q_public_licen[cs]e(?:_(?:version_|v)?1_0)?")],
    "latex-lppl": [
        (80, "latex", "this_work_may_be_distributed_and_or_modified_under_the_conditions_of_the_latex_project_public_licen[cs]e"),
        (65, "latex", "latex_project_public_licen[cs]e"),
        (55, "lppl", "lppl_1_3[abc]?"),
    ],
    "blue-oak": [(70, "blue", "blue_oak_model_licen[cs]e(?:_1_0_0)?")],
    "public-domain": [
        (70, "domain", "released_(?:in)?to_the_public_domain"),
        (70, "domain", "dedicated_to_the_public_domain"),
        (65, "domain", "placed_in(?:to)?_the_public_domain"),
        (60, "domain", "is_in_the_public_domain"),
        (65, "domain", "hereby_place_(?:it|this_.{1,40}?)_in_the_public_domain"),
        (70, "creativecommons", "creativecommons_org_publicdomain_mark"),
        (50, "domain", "public_domain_(?:software|work|dedication)"),
    ],
    "proprietary": [
        (70, "confidential", "confidential_and_proprietary"),
        (70, "proprietary", "proprietary_and_confidential"),
        (75, "unauthori", "unauthori[sz]ed_(?:copying|reproduction|distribution|use)_of_this_(?:file|document|software|material)"),
        (70, "without", "may_not_be_(?:reproduced|copied|distributed)_(?:in_any_form_)?without_(?:the_)?(?:prior_)?(?:written_)?(?:permission|consent)"),
        (75, "reproduced", "no_part_of_this_(?:publication|book|document|work)_may_be_reproduced"),
        (65, "trade", "(?:contains|constitutes)_trade_secrets"),
        (60, "proprietary", "proprietary_licen[cs]e"),
        (70, "agreement", "end_user_licen[cs]e_agreement"),
        (60, "eula", "eula"),
        (65, "internal", "for_internal_use_only"),
        (65, "redistribute", "(?:do_not|may_not|not_to)_redistribute"),
        (40, "reserved", "all_rights_reserved"),
        (40, "derechos", "todos_los_derechos_reservados"),
        (40, "droits", "tous_droits_réservés"),
        (40, "rechte", "alle_rechte_vorbehalten"),
    ],
    "noncommercial": [
        (60, "commercial", "for_non_?commercial_(?:use|purposes)_only"),
        (55, "only", "for_(?:academic|research)_(?:use|purposes)_only"),
        (60, "commercial", "commercial_use_is_(?:strictly_)?prohibited"),
        (55, "personal", "for_personal_use_only"),
        (60, "evaluation", "for_evaluation_purposes_only"),
    ],
    "freeware": [(50, "freeware", "(?:this_)?(?:software_|program_)?is_freeware"), (45, "shareware", "(?:this_)?(?:software_|program_)?is_shareware")],
    "copyright": [
        (30, "copyright", "copyright_c(?:_[12][0-9]{3})?"),
        (30, "copyright", "copyright_(?:[12][0-9]{3}_)?by"),
        (30, "copyright", "copyright_holders?"),
        (30, "copyright", "copyright_[12][0-9]{3}(?:_[12][0-9]{3})?"),
        (30, "©", "©_?(?:[12][0-9]{3})"),
    ],
    "license-reference": [
        (40, "licen", "see_(?:the_)?(?:accompanying_)?(?:file_)?licen[cs]e(?:_(?:txt|md))?_(?:file_)?for_(?:more_)?(?:details|information|the_full)"),
        (40, "terms", "licen[cs]ed_under_the_terms_(?:described|found|specified)_in"),
        (40, "copying", "see_(?:the_)?(?:file_)?copying(?:_file)?_for"),
        (35, "notice", "see_(?:the_)?notice_file_distributed_with_this_work"),
        (40, "dual", "dual_licen[cs]ed_under"),
        (35, "permission", "used_(?:with|by)_permission"),
    ],
}

#: Identifiers of license expressions, and their labels.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit-0", "x11": "mit", "apache-2.0": "apache-2", "apache-1.1": "apache-1.1", "apache-1.0": "apache-1",
    "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "bsd-4-clause": "bsd-4-clause", "0bsd": "0bsd", "isc": "isc",
    "zlib": "zlib", "libpng-2.0": "libpng", "bsl-1.0": "boost-1", "busl-1.1": "busl-1.1", "gpl-1.0": "gpl-1", "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3", "lgpl-2.0": "lgpl-2", "lgpl-2.1": "lgpl-2.1", "lgpl-3.0": "lgpl-3", "agpl-3.0": "agpl-3",
    "gfdl-1.3": "gfdl", "mpl-1.1": "mpl-1.1", "mpl-2.0": "mpl-2", "epl-1.0": "epl-1", "epl-2.0": "epl-2", "cpl-1.0": "cpl-1",
    "cddl-1.0": "cddl-1", "cddl-1.1": "cddl-1", "eupl-1.1": "eupl-1.1", "eupl-1.2": "eupl-1.2", "artistic-1.0": "artistic-1",
    "artistic-2.0": "artistic-2", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0-1.0": "cc0-1", "cc-by-4.0": "cc-by-4",
    "cc-by-3.0": "cc-by-3", "cc-by-2.0": "cc-by-2", "cc-by-sa-4.0": "cc-by-sa", "cc-by-sa-3.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "odbl-1.0": "odbl", "odc-by-1.0": "odc-by",
    "pddl-1.0": "pddl", "ofl-1.1": "ofl-1.1", "psf-2.0": "python-2", "python-2.0": "python-2", "ruby": "ruby", "php-3.01": "php-3",
    "openssl": "openssl", "curl": "curl", "icu": "icu", "unicode-3.0": "icu", "postgresql": "postgresql", "json": "json", "beerware": "beerware",
    "ms-pl": "ms-pl", "ms-rl": "ms-rl", "osl-3.0": "osl-3", "afl-3.0": "afl-3", "ncsa": "ncsa", "w3c": "w3c", "vim": "vim", "sspl-1.0": "sspl-1",
    "elastic-2.0": "elastic-2", "upl-1.0": "upl-1", "mulanpsl-2.0": "mulan-2", "blueoak-1.0.0": "blue-oak", "lppl-1.3c": "latex-lppl",
    "classpath-exception-2.0": "gpl-exception", "gcc-exception-3.1": "gpl-exception", "llvm-exception": "apache-2",
}
